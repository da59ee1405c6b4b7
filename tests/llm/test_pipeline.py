"""The corpus pipeline's stages and run() against brute force on small tables with nulls, repeats and nothing."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from ampliflow.llm import quality, toxicity
from ampliflow.llm.textops import chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light moves over under green paper seven clouds many small trees grow slowly".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)


def test_near_copies_at_five_words_and_four_fifths(spark):
    """One changed word in 45: 5-word Jaccard 36/46 = 0.78; in 50: 41/51 = 0.80; 4-word Jaccard 43/51 = 0.84, below 0.85."""
    words = [f"w{i}" for i in range(95)]
    a, b = words[:45], words[45:]
    changed = lambda w: [*w[:20], "other", *w[21:]]
    rows = [(i, " ".join(w)) for i, w in enumerate((a, changed(a), b, changed(b)), 1)]
    kept = corpus_pipeline.one_of_each(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def components(rows, k=5, percent=80):
    """Smallest id of each row's component; rows are (id, text)."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = defaultdict(list)
    for i, v in enumerate(label):
        if rows[i][0] is not None:
            least[v].append(rows[i][0])
    return [min(least[v], default=None) for v in label]


def leaked(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    for item in items:
        q = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
        n = min(8, len(q))
        wins = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if q else set()
        if any(tuple(w[i : i + n]) in wins for i in range(len(w) - n + 1)):
            return True
    return False


def scores(model, texts):
    out = []
    for _, _, flat, offsets in chunks(pa.array(texts, pa.string())):
        found = model.scores(flat, offsets)
        out.append(found[0] if isinstance(found, tuple) else found)
    return np.concatenate(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows, labels = [], []
    for i in range(260):
        text, q, x = ". ".join(" ".join(rng.choices(WORDS, k=12)) for _ in range(rng.randint(2, 6))), 1, 0
        kind = rng.random()
        if kind < 0.2:
            text, q = text.upper().replace(" ", "!! "), 0
        elif kind < 0.4:
            text, x = text.replace(". ", " idiotix scumble. ", 1), 1
        elif kind < 0.5:
            text += " " + item
        elif kind < 0.7 and i:
            w = rng.choice(rows)[1].split(" ")
            w[-1] = rng.choice([w[-1], "changed"])
            text, q, x = " ".join(w), None, None
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", "b", None]), len(text)))
        labels.append((i, q, x))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (None, rows[5][1], "en", "a", 1), (None, "free of ids", "en", "b", 1), rows[7], rows[7]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder, rows, item


def test_run_equals_brute_force(spark, tables):
    folder, rows, item = tables
    docs, labels = spark.read.parquet(folder + "/documents.parquet"), spark.read.parquet(folder + "/labels.parquet")
    good, toxic = quality.fitted(docs, labels), toxicity.fitted(docs, labels)
    kept = [r for r, s in zip(rows, scores(good, [r[1] for r in rows]), strict=True) if s >= quality.THRESHOLD]
    assert 0 < len(kept) < len(rows)
    left = [r for r, s in zip(kept, scores(toxic, [r[1] for r in kept]), strict=True) if s < toxicity.THRESHOLD]
    assert 0 < len(left) < len(kept)
    one = {r: None for r, c in zip(left, components([r[:2] for r in left]), strict=True) if r[0] is None or c is None or r[0] == c}  # repeats of a row once
    assert 0 < len(one) < len(left)
    wanted = [r for r in one if not leaked(r[1], [item])]
    assert 0 < len(wanted) < len(one)
    found = corpus_pipeline.run(spark, folder).collect()
    order = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.source, r.text, r.size) for r in found), key=order) == sorted(((i, s, t, len((t or "").split())) for i, t, _, s, _ in wanted), key=order)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert len(r.positions) == r.copies + (r.taken > r.copies * r.size) if r.size else r.positions == []
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    places = [r.position for r in found if r.position is not None]
    assert places == sorted(places)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tables, name, stage):
    """Extra columns with names of the stages' own stay or do no harm, and no rows give no rows."""
    folder, _, _ = tables
    docs = spark.read.parquet(folder + "/documents.parquet")
    for c in ("_score", "score", "_id", "_h", "_row", "component_id", "n_words", "_leaked_id", "_where", "size"):
        docs = docs.withColumn(c, docs["lang"])
    out = stage(spark, docs, folder)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == docs.columns
    assert 0 < out.count() <= docs.count()
    assert stage(spark, docs.limit(0), folder).count() == 0
