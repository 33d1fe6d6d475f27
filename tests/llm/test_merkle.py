"""The manifest against a plain tree, on odd rows, and what it notices."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from platefold.llm import merkle
from platefold.llm import queries as Q
from pyspark.sql import functions as F

from ..conftest import SF
from ..oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, g string, idx string, n long, place string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r) -> str:
    return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS))


def climb(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The last node, and each first node's siblings by level."""
    proofs: list[list] = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        place = [p // 16 for p in place]
    return nodes[0], proofs


def plain(rows: list[dict]) -> list[tuple]:
    order = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of, tops = {}, []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (order(r["doc_id"]), leaf(r)))
        top, proofs = climb([leaf(r) for r in own])
        of[s] = own, top, proofs
        tops.append(top)
    root, upper = climb(tops)
    out = []
    for s, above in zip(sources, upper, strict=True):
        own, top, proofs = of[s]
        for r, p in zip(own, proofs, strict=True):
            steps = p + above
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf({**r, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])}) if tampered and r["text"] is not None else leaf(r)
            for before, after in steps:
                node = h(before, node, after)
            out.append((str(r["doc_id"]), leaf(r), top, root, h(*(b + a for b, a in steps)), node, node == root))
    return sorted(out)


def found(df) -> list[tuple]:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.verified(df, other={"text": lowered}, where=F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect())


def rows(sizes: dict) -> list[dict]:
    r, out, n = random.Random(3), [], 0
    texts = ["", None, "Ünïcode ÄB", "a:b|1", "Text " * 3, "AKIA", "x" * 40_000]
    for s, size in sizes.items():
        for _ in range(size):
            n += 1
            out.append({"doc_id": r.choice([n, n, n, -n, 7, None]), "text": r.choice(texts), "lang": r.choice(["en", None, ""]), "source": s, "n_chars": r.choice([None, 0, n]), "hash": "z", "g": None, "idx": "0", "n": 1, "place": "p"})
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {None: 3, "": 1, "z": 300, "é": 33, "-": 2, "=": 5}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_trees(spark, sizes):
    data = rows(sizes)
    assert found(spark.createDataFrame(data, SCHEMA).repartition(5)) == plain(data)


def test_equal_rows(spark):
    data = [{**rows({"a": 1})[0], "doc_id": 4}] * 700 + rows({"b": 20})
    assert found(spark.createDataFrame(data, SCHEMA)) == plain(data)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_lower_order_columns_are_named(spark):
    """Other fields, groups and orders than the defaults."""
    df = spark.createDataFrame([(k % 3, k, f"v{k}") for k in range(50)], "part int, at int, v string")
    m = merkle.build(df, fields=("at", "v"), group="part", order="at")
    got = m.proofs().withColumn("again", merkle.fold(F.col("leaf"), F.col("steps")))
    assert got.where("again <> root").count() == 0
    assert got.count() == 50


def test_query(spark):
    q = Q.queries()["op13_merkle_manifest"](spark, SF)
    assert_same(q, Q.oracle_sql()["op13_merkle_manifest"], SF)
