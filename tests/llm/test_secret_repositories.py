"""Secrets that few owners show, in few and in many texts."""

from __future__ import annotations

from measura.llm import op2_secrets, secrets

COPIED, OWN, AGAIN, SHARED = "Zq3" + "aB4" * 9, "Yq3" + "aB5" * 9, "Xq3" + "aB6" * 9, "Wq3" + "aB7" * 9


def test_one_owner_in_many_texts_is_a_copied_example(spark, tmp_path):
    texts = [(f"copy {k} of {COPIED} and AKIA{'Z' * 16}", "hot") for k in range(9)]
    texts += [(f"text {k} of {OWN}", "hot") for k in range(8)]
    texts += [(f"one text with {AGAIN}", "hot")] * 20
    texts += [(f"note with {SHARED}", f"s{k}") for k in range(3)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    seen = {}
    for r in secrets.scan(docs).collect():
        for x in r["found"]:
            seen.setdefault((secrets.KINDS[x["kind"]], x["value"]), []).append((x["owners"], x["repositories"], x["live"]))
    assert seen == {("access", "AKIA" + "Z" * 16): [(1, 9, False)] * 9, ("token", OWN): [(1, 8, True)] * 8, ("token", AGAIN): [(1, 1, True)] * 20}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op2_secrets.query(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_access"], r["n_live"]) for r in rows) == [(i, int(i < 9), int(9 <= i < 37)) for i in range(40)]
    assert all(("token" in r["spans"]) == (9 <= r["doc_id"] < 37) for r in rows)
