"""Filter audit, prefix trie and neighbour search against brute force, with odd rows."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import filter_audit, neighbours, prefix_trie


def audited(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    verdicts = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = [j for j, other, _ in docs if (other or "") == text and j is not None and (i is None or j < i)]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": bool(smaller)}
        good, toxic = (any(r[k] == 1 for r in labels if r[0] == i and i is not None) for k in (1, 2))
        verdicts.append((lang or "", "".join(x for x in "ABCDE" if fails[x]), good, toxic))
    rows, removed_by = {}, {}
    for part in {v[0] for v in verdicts}:
        mine = [v[1:] for v in verdicts if v[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                gone = lambda f: any(x in f for x in order[: step - 1])  # noqa: B023, E731
                lost = [v for v in mine if letter in v[0] and not gone(v[0])]
                rows[part, order, step] = [
                    sum(letter not in v[0] and not gone(v[0]) for v in mine), len(lost), sum(letter in v[0] and gone(v[0]) for v in mine), sum(v[0] == letter for v in mine), sum(v[1] for v in lost), sum(v[2] for v in lost),
                ]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(lost)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_audit_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(260))
    docs = [(1, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (4, None, "en"), (5, "", None), (2, long, "en"), (6, "Many CAPITALS HERE & there", "de"), (7, "same " * 300, "de"), (8, f"{long} 50%", "de"), (9, long + " x", "")]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (8, 1, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*r, 7, 7, 7) for r in docs], "doc_id long, text string, lang string, mask int, n int, digest int")
    known = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, text int")
    found = filter_audit.interactions(*filter_audit.cells(frame, known))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in found.collect()}
    assert got == audited(docs, labels) and len(got) == 3 * 600
    assert filter_audit.interactions(*filter_audit.cells(frame.limit(0), known)).count() == 0
    assert filter_audit.interactions(*filter_audit.cells(frame, known.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def trie_of(rows):
    """Nodes of (conv_id, turn, role, text) rows, by whole sequences."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0), digest, (r, x)))
    own = {c: [z[2] for z in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = {}
    for c, s in paths.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(nodes, key=len, reverse=True):
        under = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in under) or 1
        saved[p] = sum(saved[q] for q in under) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(paths[c]) == len(p))))
        out.add((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(under), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (5, 7)])
def test_trie_equals_brute_force(spark, primes):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t % 3} of {c % 4}") for c in [*range(100, 112), *range(300, 304), 555] for t in range(c % 7 + 1)]
    # A conversation over many pieces, with a near copy; odd rows; repeated rows and numbers; no first conversation of the hundred.
    rows += [(200, t, "user", f"long {t}") for t in range(700)] + [(201, t, "user", f"long {t}" if t < 650 else "else") for t in range(700)]
    rows += [(401, None, None, None), (401, None, "a", ""), (401, 5, "", "a"), (402, 1, "x", "y"), (402, 1, "x", "y"), (402, 1, "x", "z"), (403, 1, "\U0001f600", "café"), (None, 1, "x", "y"), (404, 1, "ab", "c"), (405, 1, "a", "bc"), (-5, 1, "n", "m")]
    frame = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "conv_id long, turn long, role string, text string, depth int, at int, f int")
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame, primes).select(*NODE).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_of(rows)


def test_trie_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)  # takes its first turn from 0, which is absent
    one = prefix_trie.prefix_trie(spark.createDataFrame([(turnless, 1, "a", "b")], kind)).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves) for r in one] == [(turnless, 0, None, 1, 1)]


def near(rows, every, k=10):
    """(query, [(vec_id, distance)]) of each sound row divisible by ``every``."""
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = []
    for a, (i, v) in enumerate(sound):
        if i % every == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for b, (j, w) in enumerate(sound) if b != a and len(w) == len(v))
            out.append((i, [(j, s) for s, j in found[:k]]))
    return out


def searched(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {i: [(j, s) for _, j, s in sorted(x)] for i, x in out.items()}


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(100, None), (200, [None, 1.0]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, [0.0, 0.0]), (600, []), (None, [1.0, 1.0]), (700, [1.0]), (900, [2.0, 2.0, 2.0]), (901, [2.0, 2.0, 1.0]), (902, [-0.0, 2.0, 1.0]), (903, [0.0, 2.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, leaf int, bin int")
    vectors = neighbours.sound_vectors(frame)
    got = searched(neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")))
    assert got == {i: x for i, x in near(rows, 100) if x}
    assert got[0][:3] == [(5, 0.0), (10, 0.0), (15, 0.0)] and 700 not in got
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0])]
    vectors = neighbours.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest(vectors, vectors.where("vec_id = 100")).collect())
    assert got == sorted(2 * [(1, 1, 0.0), (2, 100, 0.0), (3, 100, 1.414214)] + [(1, 1, 1.414214), (2, 100, 1.414214), (3, 100, 1.414214)])


def test_recall_of_many_bins(spark, monkeypatch):
    """Clusters, noise and a third of all rows alike; leaves and queries of several bins and chunks."""
    monkeypatch.setattr(neighbours, "SAMPLE", 600)
    monkeypatch.setattr(neighbours, "BIN_BYTES", 8 * 16 * 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = [*(centres[rng.integers(30, size=800)] + 0.2 * rng.normal(size=(800, 16))), *rng.normal(size=(700, 16)), *np.tile(centres[:1], (750, 1))]
    order = rng.permutation(len(vectors))
    rows = [(int(i), [float(x) for x in vectors[j]]) for i, j in enumerate(order)]
    frame = neighbours.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = searched(neighbours.nearest(frame, frame.where("vec_id % 10 = 0")))
    want = dict(near(rows, 10))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in x}) for i, x in want.items())
    assert hits >= 0.9 * 10 * len(want)
    lengths = {i: np.array(v) for i, v in rows}
    assert all(s == float(np.sqrt(((lengths[i] - lengths[j]) ** 2).sum())) for i, x in got.items() for j, s in x)
    copies = [i for i in want if order[i] >= 1500]
    assert copies and all(got[i] == want[i] for i in copies)
