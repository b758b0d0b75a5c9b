"""Small tables with every odd case, written as the queries read them."""

from __future__ import annotations

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank at night."
LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(60_000))

DOCS = [
    (1, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (3, None, None, None, None),
    (None, PROSE + " More.", "en", None, 3),
    (None, None, "en", "b", 0),
    (4, "", "en", "b", 0),
    (5, "   \n\t \x0b ", "en", "b", 0),
    (6, "123 456 !!! ###", None, "b", 0),
    (7, f"Before. {BENCH.replace('eta', 'ETA', 1)} after that.", "en", "b", 0),
    (8, LONG, "en", "b", 0),
    (9, "x" * 300_000, "fr", "b", 0),
    (10, "Released under the MIT License.\r\n" + PROSE, "en", "b", 0),
    (11, "é è <|endoftext|> <|startoftext|> 你好 Σας ΑΣ İ \U0001f600 ́", "fr", "b", 0),
    (12, "Le chat et le chien sont dans la maison avec les enfants pour la nuit.", "fr", "b", 0),
    (13, "Der Hund und die Katze sind in dem Haus mit den Kindern in der Nacht.", "de", "b", 0),
    (-1, "A\nA\nA\nB\n", "en", "b", 0),
]
DOCS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("score", "fp", "seed", "slot", "kept", "root", "h", "p", "a", "n_tokens", "lang_pred", "predicted", "_row_hash", "key", "_metadata", "_file", "file", "row")
LABELS = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (6, 0, 0), (None, 1, 0), (99, 1, 1), (4, None, None), (8, 7, 0), (12, 1, 0)]
BENCHMARK = [(1, BENCH), (1, BENCH), (2, None), (3, ""), (None, "too short an item"), (4, PROSE)]
PAGES = [
    (1, "https://user@A.example.com:80/x/y?z#f", "h"), (1, "https://user@A.example.com:80/x/y?z#f", "h"), (2, None, None), (3, "", ""), (None, "http://b.example.com/", "h"),
    (4, "no url", "h"), (5, "http://localhost/a//b/", "h"), (6, "http://" + "/".join(f"p{k}" for k in range(300)), "h"),
]


def write(spark, path, docs=DOCS, labels=LABELS, benchmark=BENCHMARK, pages=PAGES, extra=True):
    from pyspark.sql import functions as F

    frames = {
        "documents": spark.createDataFrame(docs, DOCS_SCHEMA),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame(benchmark, "item_id bigint, text string"),
        "pages": spark.createDataFrame(pages, "page_id bigint, url string, html string"),
    }
    for name, df in frames.items():
        if extra:
            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
