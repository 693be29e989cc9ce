import hashlib
import re

import pytest

from delaylake.llm import secrets as op
from delaylake.llm.queries import op1_secret_scan

BASE = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


TEXTS = [
    None, "", "password=hunter22", 'Token : "abcdef" API_key=\'x/y+z=1\'', "secret:token:abcdefg token=abc", "é🙂 passwd = 12345", "é🙂 PASSWD = 123456",
    "AKIA" + "A" * 15, "AKIA" + "B" * 16, "xAKIAAKIA" + "C" * 16 + "AKIA", "f" * 23, "g" + "0a" * 12 + "F", "token=" + "0123456789abcdef" * 3, "api_key==" + "a" * 40,
    "ſecret=abcdefg Key", "token=token=abcdef", "a" * 200_000 + " secret=abcdefgh " + "deadbeef" * 4, "password:\nabcdefgh", "apikey = \"A.b-C_d\" apikey=short1",
]


def lists(rows):
    return sorted(((r["path"], [f"{f['rule']}:{f['start']}:{f['end']}" for f in r["findings"]]) for r in rows), key=str)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[2])]
    docs = spark.createDataFrame([(i, t, b"clash", "x") for i, t in rows], "doc_id long, text string, blob binary, rule string")
    got = lists(op.scan_versions(docs, op.fresh_ledger(spark), "doc_id").collect())
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)
    assert op.scan_versions(docs.limit(0), op.fresh_ledger(spark), "doc_id").count() == 0


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    ledger = op.fresh_ledger(spark)
    seen = []
    scan = op.scan_blobs
    monkeypatch.setattr(op, "scan_blobs", lambda blobs, rules: seen.append(sorted((r["text"], sorted(r["todo"])) for r in blobs.collect())) or scan(blobs, rules))
    first = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("c", "none")], "path string, text string")
    assert lists(op.scan_versions(first, ledger).collect()) == [("a", ["assign:0:12"]), ("b", ["assign:0:12"]), ("c", [])]
    both = first.union(spark.createDataFrame([("a", "secret=abcdef"), ("d", "none")], "path string, text string"))
    got = lists(op.scan_versions(both, ledger).collect())
    assert got == [("a", ["assign:0:12"]), ("a", ["assign:0:13"]), ("b", ["assign:0:12"]), ("c", []), ("d", [])]
    newer = (op.RULES[0]._replace(version=2, least=100), *op.RULES[1:])
    assert lists(op.scan_versions(first, ledger, rules=newer).collect()) == [("a", []), ("b", []), ("c", [])]
    all_ = ["access", "assign", "hex"]
    assert seen == [[("none", all_), ("token=abcdef", all_)], [("secret=abcdef", all_)], [("none", ["assign"]), ("token=abcdef", ["assign"])]]
    assert lists(op.scan_versions(first, ledger, rules=newer).collect()) == [("a", []), ("b", []), ("c", [])]
    assert seen[3] == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_secret_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert r["spans"] == ",".join(want) and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
