import hashlib
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root and, for each leaf, its siblings and the function that folds another leaf; run by run, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + 3]) for i in range(0, len(below), 3)])
    proofs = []
    for i in range(len(leaves)):
        steps, at = [], i
        for level in levels[:-1]:
            first = at // 3 * 3
            steps.append((level[first:at], level[at + 1:first + 3]))
            at //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def fold(own, steps):
    for left, right in steps:
        own = h(*left, own, *right)
    return own


def brute(rows):
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=order) for s in sources}
    folded = {s: tree([leaf(r) for r in t]) for s, t in trees.items()}
    root, above = tree([folded[s][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for r, steps in zip(trees[s], folded[s][1]):
            steps = steps + above[place]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            end = fold(leaf((*r[:4], text)), steps)
            proof = h(*(x for left, right in steps for x in (*left, *right)))
            out.append((r[0], leaf(r), folded[s][0], root, proof, end, end == root))
    return sorted(out, key=repr)


def audit(spark, rows, parts=3, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for name in extra:
        docs = docs.withColumn(name, F.lit("x"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.audited(docs, FIELDS, "source", "doc_id", {"text": text}).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    sources = ["hot", None, "", "é", "z", "Z"]
    return [(int(i), sources[0] if i % 3 == 0 else sources[rng.integers(6)], [None, "en"][i % 2], int(i) * 7,
             f"line {i}\nmore" if i % 4 else "one line") for i in rng.permutation(n)]


def test_equals_plain_trees(spark):
    rows = rows_of(400)
    found = audit(spark, rows)
    assert found == brute(rows)
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # used on the driver: blocks of nine leaves
    rows = rows_of(300, 2)
    assert audit(spark, rows, extra=("idx", "tree", "kind", "proof")) == brute(rows)


def test_defined_cases(spark):
    long = "word\n" * 200_000
    rows = [(1, "a", None, None, None), (2, "a", "en", 0, ""), (4, None, None, 1, long), (3, None, "", 2, "\n\n"),
            (None, "b", "en", 3, "x\ny"), (None, "b", "en", 3, "x\ny"), (5, "b", "en", 3, "x\ny"), (5, "b", "en", 3, "x\ny"),
            (5, "b", "en", 3, "other")]
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, rows[:1]) == brute(rows[:1])  # a lone leaf is the root, its proof is empty
    assert audit(spark, []) == []


def test_proofs_of_some_leaves(spark, monkeypatch):
    """Siblings that are not asked for are fetched too, inside a block as well."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = spark.createDataFrame([("=a", i, h(str(i))) for i in range(50)] + [("=b", 1, h("b"))], "tree string, doc_id long, leaf string")
    manifest = merkle.build(rows)
    some = manifest.leaves.where(F.col("doc_id").isin(1, 2, 17, 49))
    proofs = merkle.prove(manifest, some).withColumn("end", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(proofs) == 5 and {r.end for r in proofs} == {manifest.root}


def test_root_does_not_depend_on_the_layout(spark):
    rows = rows_of(200, 3) + rows_of(20, 4)
    assert audit(spark, rows, 1) == audit(spark, rows, 13)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 200), st.data())
def test_multiproof_is_sufficient_and_minimal(n, data):
    known = np.array(sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1))))
    sizes = merkle.level_sizes(n)
    nodes = {(0, i): str(i) for i in range(n)}
    root = merkle.derive(nodes, list(range(n)), sizes)
    needed = {(level, int(i)) for level, idx in merkle.missing_nodes(known, sizes) for i in idx}
    given_nodes = {k: nodes[k] for k in needed} | {(0, int(i)): str(i) for i in known}
    assert merkle.derive(dict(given_nodes), known.tolist(), sizes) == root
    for k in needed:  # without any one of them it cannot be derived
        try:
            merkle.derive({a: b for a, b in given_nodes.items() if a != k}, known.tolist(), sizes)
        except KeyError:
            continue
        raise AssertionError(k)
    memo = {}
    derived = dict(given_nodes)
    merkle.derive(derived, known.tolist(), sizes)
    for i in known.tolist():
        steps = [([s["left"]], [s["right"]]) for s in merkle.path(derived, i, sizes, memo)]
        assert fold(str(i), steps) == root
