"""Secret scans against the base patterns as they are stated, and ownership by counting."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from ordermill.llm import queries
from ordermill.llm.secret_ownership import base_matches, find_secrets, span_text

SF = "/root/testdata/sf0.001"
PLAIN = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]


def base(text):
    spans = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern, group, least) in enumerate(PLAIN)
        for m in re.finditer(pattern, text or "")
        if len(m[group]) >= least
    ]
    return ",".join(s for _, _, s in sorted(spans))


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_secret_ownership"](spark, SF).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == {k: hashlib.sha256(base(x).encode()).hexdigest() for k, x in texts.items()}
    for r in rows:
        spans = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(spans.count(k) for k in ("assign", "access", "hex"))
        assert set(base(texts[r["doc_id"]]).split(",")) <= set(r["spans"].split(","))


def test_base_matches_of_random_texts():
    dice = random.Random(1)
    parts = ["password", "API_KEY", "apikey", "token", "secret", "=", ":", " ", '"', "'", "AKIA", "0123456789abcdef", "abc", "é", "\n", "."]
    for _ in range(3000):
        text = "".join(dice.choice([*parts, dice.choice(string.ascii_letters)]) for _ in range(dice.randrange(40)))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base_matches(text)) == base(text)


def test_ownership(spark):
    live, example = "Ab3" + "x" * 20, "Zz9" + "y" * 20
    rows = [(1, f"é {live} password=hunter2hunter2", "a"), (2, f"{live}", "a"), (3, example, "a"), (4, example, "b"),
            (5, None, None), (6, "", "c"), (7, "password: hunter2hunter2", None), (7, "password: hunter2hunter2", None), (None, "f" * 40, "c"),
            (8, "word " * 200_000 + live, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"FOUND": F.lit(1), "value": F.lit(2)})
    found = find_secrets(frame)
    got = sorted((r["doc_id"] or 0, r["s"], [x["owners"] for x in r["found"]]) for r in found.withColumn("s", span_text("found")).collect())
    assert got == [
        (0, "hex:0:40", [1]),
        (1, "opaque:2:25,assign:26:49", [1, 2]),
        (2, "opaque:0:23", [1]),
        (3, "", []), (4, "", []), (5, "", []), (6, "", []),
        (7, "assign:0:24", [2]), (7, "assign:0:24", [2]),
        (8, "opaque:1000000:1000023", [1]),
    ]
    assert find_secrets(frame.limit(0)).collect() == []
