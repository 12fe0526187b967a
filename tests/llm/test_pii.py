import hashlib
import re

from pyspark.sql import functions as F

from volatide.llm import pii, queries

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FORMS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


TEXTS = [
    None, "", "nothing here", "ünï a.b@c.de, x@y and p@q.r_s@t.u %@-.- a@b.c.d@e.f @x.y a@@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.2.3 1.2.3 999.1.1.1.1 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111112",
    "+1 (555) 010-9999. +49.30.1234567 +12 +123456789012345678 ++1 23456789(", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE89370400440532013001",
    "é" * 50 + "call +1 555 123 4567 mail a@b.co", "a" * 6_000 + "@", "1" * 60_000, "+1" + "." * 30_000 + "x", "x@y.z " * 300, "1 2-" * 20_000,
]


def test_spans_match_plain_regular_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = pii.find_spans(df).select("doc_id", pii.joined(F.col("pii_spans"), pii.BASE).alias("base"), pii.joined(F.col("pii_spans")).alias("all")).collect()
    for r in rows:
        assert r["base"] == ",".join(brute(TEXTS[r["doc_id"]])), r["doc_id"]
    all_of = {r["doc_id"]: r["all"] for r in rows}
    assert all_of[7].count("iban") == 2


def test_query_on_all_documents_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(x.startswith(kind) for x in expected)


def test_redaction_context_and_clashing_columns(spark):
    df = spark.createDataFrame([("mail me: a@b.co or +1 555 123 4567!", "k"), (None, "k"), ("clean", "k")], "text string, kind string")
    out = pii.redact(pii.find_spans(df)).collect()
    assert [r["text"] for r in out] == ["mail me: <EMAIL> or <PHONE>!", None, "clean"]
    assert out[0]["pii_spans"][0]["score"] == 1.0 and out[0]["kind"] == "k"
    assert pii.find_spans(df.where("1 = 0")).count() == 0


def test_odd_texts_match_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 20_000]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(queries.ORACLES["op9_pii"]).fetchall())
    assert sorted(tuple(r) for r in queries.op9_pii(spark, str(tmp_path)).collect()) == want
    assert sum("iban" in w[-1] for w in want) == 1


def test_a_text_full_of_matches_takes_time_in_proportion(spark):
    import time

    line = "Ünï mail a%d@b.co or call +1 555 123 %04d at 10.0.0.1, "
    text = "".join(line % (i, i % 10000) for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.redact(pii.find_spans(df)).collect()[0]
    assert time.time() - began < 60
    found = [f"{s['kind']}:{s['start']}:{s['end']}" for s in row["pii_spans"]]
    assert len(found) == 120_000 and found == brute(text)
    assert row["text"] == "Ünï mail <EMAIL> or call <PHONE> at <IP>, " * 40_000


def test_overlapping_spans_are_covered_together_and_names_may_clash(spark):
    df = spark.createDataFrame([("x 4111 1111 1111 1111@mail.com 😀 +378282246310005 y", 1, 2, 3)], "text string, __pii_wide int, pii_spans int, __PII_card int")
    out = pii.redact(pii.find_spans(df))
    assert out.columns == ["text", "__pii_wide", "pii_spans", "__PII_card"]
    row = out.collect()[0]
    assert row["text"] == "x <CARD> 😀 <PHONE> y" and (row["__pii_wide"], row["__PII_card"]) == (1, 3)
