"""Small tables with the awkward cases: NULLs, empty and long texts, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the noisy old town at dawn every day"
NEAR = BASE + " again"
LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
ROWS = [
    (1, BASE, "en", "a"), (2, NEAR, "en", "a"), (2, NEAR, "en", "a"), (3, BASE, "en", None), (4, None, None, "a"), (5, "", "en", "b"),
    (6, "... 123 !!!", None, "b"), (7, LONG, "en", "b"), (8, f"start {LEAK} end of it", "en", "c"),
    (9, "Mail a.b@mail.example.com, card 4111 1111 1111 1111, born 2001-02-03.", "en", "c"), (None, BASE, None, None),
    (10, "Das ist die Sprache der Straße und der Häuser, für alle.", "de", "c"), (11, "und die Größe der Häuser für alle Straßen", "de", "c"),
    (12, "one", "en", "a"), (13, "one", "en", "a"),
]
#: Names that the operators use inside.
CLASHES = ["words", "_text", "_id", "id", "tokens", "digest", "component", "component_id", "leaks", "c0", "c1", "new", "n_words", "score", "kept", "_p", "_enc", "rid", "label", "host", "path", "payload", "size"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def pages(spark, rows=None):
    html = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One sentence of text, long enough to read. And more.</p></article><footer>Foot</footer></body></html>"
    rows = rows if rows is not None else [
        (3, "http://www.a.example.org/en/1?x", html), (1, "https://b.example.com/fr/2#y", html), (2, "https://b.example.com/fr/2#y", html), (2, "https://b.example.com/fr/2#y", html),
        (4, None, None), (5, "no scheme", ""), (6, "http://x.net", "<p>" + LONG), (7, "http://EXAMPLE.org/es/\nz", "short"), (None, "http://q.com/de/1", html), (8, "://", "short"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def benchmark(spark):
    return spark.createDataFrame([(1, LEAK), (2, "lazy dog"), (3, None), (None, "old town"), (4, "")], "item_id long, text string")


def put(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
