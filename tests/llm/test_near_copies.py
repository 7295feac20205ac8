import random
import re

from millrace.llm.near_copies import drop_near_copies


def stay(rows, shingle=5, similarity=0.8):
    """Ids that stay, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))})
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and len(a & b) >= similarity * len(a | b) - 1e-9:
                part = [part[j] if p == part[i] else p for p in part]
    return sorted(min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in set(part))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def test_reaches_its_similarity_and_no_further(spark):
    rng, rows = random.Random(4), []
    for g in range(25):
        base = [f"{g}w{rng.randrange(10_000)}" for _ in range(300)]
        rows += [(10 * g + k, " ".join(changed(rng, base, n))) for k, n in enumerate((0, 1, 4, 6, 8, 12))]
    want = stay(rows)
    assert 25 < len(want) < 100
    assert ids(drop_near_copies(frame(spark, rows))) == want


def test_large_buckets(spark):
    """A family of which most members are joined by way of others only, in blocks far smaller than its buckets."""
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(200)]
    for i in range(150):
        words = changed(rng, words, 1)
        rows.append((i, " ".join(words if i % 7 else changed(rng, words, 9))))
    rng.shuffle(rows)
    want = stay(rows)
    assert 1 < len(want) < 40
    for block in (500, 4):
        assert ids(drop_near_copies(frame(spark, rows), block=block)) == want


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, None), (4, ""), (6, " \n"), (1, "A b"), (2, "a  B"), (9, long), (8, long + " end"), (7, long.upper()), (3, "x" * 100_000), (10, "é À"), (11, "é à"), (12, "a b c d e f")]
    assert ids(drop_near_copies(frame(spark, rows))) == stay(rows) == [1, 3, 4, 7, 10, 11, 12]
    twice = [(3, "a"), (3, "a"), (None, "a"), (None, "only null")]
    assert sorted(map(str, (r.doc_id for r in drop_near_copies(frame(spark, twice)).collect()))) == ["3", "None"]
    assert drop_near_copies(frame(spark, rows).limit(0)).collect() == []
