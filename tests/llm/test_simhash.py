import re

import numpy as np
import xxhash

from millrace.llm.simhash import fingerprint_links, masks, query, simhash_dedup
from millrace.plans.components import connected_components


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    prints, label = list(prints), {}
    for p in prints:
        if p in label:
            continue
        label[p], front = p, [p]
        while front:
            x = front.pop()
            for y in prints:
                if y not in label and (x ^ y).bit_count() <= radius:
                    label[y] = p
                    front.append(y)
    return label


def expected(rows):
    fp = {t: brute_print(t) for t in {t for _, t in rows}}
    label = brute_components(dict.fromkeys(fp.values()))
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[label[fp[t]]] = min(i, ids.get(label[fp[t]], i))
    return sorted(((i, format(fp[t], "016x"), ids.get(label[fp[t]])) for i, t in rows), key=str)


def test_masks_cover_every_pair():
    rng = np.random.default_rng(3)
    tables = [m % 2**64 for m in masks(4)]
    assert len(tables) == 31 and all(28 <= m.bit_count() <= 36 for m in tables)
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(diff & m == 0 for m in tables)


def test_links_keep_components(spark):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(60):
        p = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 12))):
            prints.add(p - 2**63)
            p ^= sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    label = brute_components([p % 2**64 for p in prints])
    want = {frozenset(q for q in label if label[q] == r) for r in set(label.values())}
    for block in (20_000, 3):
        got = {}
        for node, part in connected_components(fingerprint_links(df, 4, block)).collect():
            got.setdefault(part, set()).add(node % 2**64)
        assert {frozenset(x) for x in got.values()} == {x for x in want if len(x) > 1}


def test_cases(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, None), (4, ""), (None, " \n"), (1, "A b"), (2, "a  B"), (9, base), (8, base + " end"), (7, base.upper()), (3, "x" * 100_000), (3, "x" * 100_000), (None, "only null"), (6, "é À c d e"), (10, " b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as least")
    got = simhash_dedup(df).selectExpr("doc_id", "lower(lpad(hex(fp),16,'0')) fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert simhash_dedup(df.limit(0)).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, query(spark, sf).collect()), key=str) == expected(rows)
