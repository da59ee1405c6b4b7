"""The corpus operators against libraries, brute force, round trips and held-out labels, and on odd inputs."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampliflow.llm import chat, components, decontam, flac, license_texts, licenses, mixing, ngram_join, quality, shared, textops, tokens, toxicity, warc
from ampliflow.llm.labelled import sample
from ampliflow.llm.shared import shared_dir, written
from ampliflow.llm.textops import chunks, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light moves over under green paper seven clouds many small trees grow slowly".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and a repeated row."""
    long_ = "word " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, long_, "en", None, 9), (5, "Same text here now ok", "en", "b", 1), (6, "Same text here now ok", "en", "b", 1), (6, "Same text here now ok", "en", "b", 1), (None, "no id é漢", "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns whose names operators might use themselves."""
    for name in ("score", "size", "n", "sid", "h", "win", "items", "rank", "target", "words", "media", "found", "_id", "_h", "_words", "_at", "_row", "_key", "_bucket"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


ITEMS = [(1, "same text here"), (None, None), (2, ""), (3, "word " * 8)]
QUALITY, TOXIC = quality.QualityModel(["a b", "C!! D!!"], [1, 0]), toxicity.ToxicityModel(["a b", "bad c"], [0, 1])


def one_score(model, text):
    (_, _, flat, offsets), = chunks(pa.array([text], pa.string()))
    found = model.scores(flat, offsets)
    return round(float((found[0] if isinstance(found, tuple) else found)[0]), 9)


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def leaks(text):
    w = plain(text)
    if w[:1] == ["same"]:
        return len(w), 3, ["1"]
    return (len(w), len(w), ["3"]) if len(w) >= 8 else (len(w), 0, [])


def padded(text):
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


#: Per operator: its run, what of a row is compared, and what a row's text must give.
OPERATORS = {
    "op3": (lambda spark, d: ngram_join.near_components(d), lambda r: r.n_shingles, lambda t: 0 if not (t or "").split() else len({tuple(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))})),
    "op5": (lambda spark, d: licenses.scan(d, licenses.template_grams(spark)), lambda r: (r.n_words, r.spans), lambda t: (len(plain(t)), [])),
    "op7": (lambda spark, d: mixing.mix(d), lambda r: r.size, lambda t: len((t or "").split())),
    "op8": (lambda spark, d: flac.features(flac.to_media(d)), lambda r: (r.n_bytes, r.payload_sha256), lambda t: (len((t or "").encode()), hashlib.sha256(padded(t)).hexdigest())),
    "op9": (lambda spark, d: tokens.token_counts(d), lambda r: r.n_bytes, lambda t: len((t or "").encode())),
    "op10": (lambda spark, d: decontam.decontaminate(d, spark.createDataFrame(ITEMS, "item_id long, text string")), lambda r: (r.n_words, r.n_hit, r.hit_items), leaks),
    "op1": (lambda spark, d: quality.scored(d, QUALITY), lambda r: round(r.score, 9), lambda t: one_score(QUALITY, t)),
    "op2": (lambda spark, d: toxicity.scored(d, TOXIC), lambda r: round(r.score, 9), lambda t: one_score(TOXIC, t)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_inputs(spark, name):
    run, seen, wanted = OPERATORS[name]
    docs = odd_docs(spark)
    found = run(spark, clashing(docs)).collect()
    order = lambda x: (x[0] is None, x[0], repr(x[1]))
    assert sorted(((r.doc_id, seen(r)) for r in found), key=order) == sorted(((r.doc_id, wanted(r.text)) for r in docs.collect()), key=order)
    assert run(spark, empty(spark)).count() == 0


def test_a_long_text_needs_bounded_tables():
    """Stretches give the hashes of one piece, whatever lies where, and one word longer than a stretch too."""
    rng = np.random.default_rng(3)
    flat = rng.integers(97, 123, 3_000_000, dtype=np.uint8)
    flat[rng.integers(0, 900_000, 150_000)] = 32
    starts, ends, _ = textops.spans(flat, np.array([0, len(flat)]), textops.SPACED)
    found = textops.span_hashes(flat, starts, ends)
    for i in (0, 1, len(starts) // 2, len(starts) - 2, len(starts) - 1):
        assert textops.span_hashes(flat[starts[i] : ends[i]], np.array([0]), np.array([ends[i] - starts[i]])) == found[i]
    value = sum((int(b) + 1) * pow(textops._P, j, 1 << 64) for j, b in enumerate(flat[starts[5] : ends[5]])) % (1 << 64)
    assert textops.mixed(np.array([value], np.uint64))[0] == found[5] and len(textops._POWERS[0]) <= textops.CHUNK_BYTES + 1


# ---- 1, 2 -----------------------------------------------------------------------------------------------------


def labelled(n, seed):
    rng = random.Random(seed)
    texts, good, toxic = [], [], []
    for _ in range(n):
        t, q, x = ". ".join(prose(rng, 12) for _ in range(rng.randint(1, 6))), 1, 0
        if rng.random() < 0.25:
            t, q = t.upper().replace(" ", "!! "), 0
        elif rng.random() < 0.25:
            w = t.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(["idiotix", "scumble", "moronous"]))
            t, x = " ".join(w), 1
        texts.append(t)
        good.append(q)
        toxic.append(x)
    return texts, good, toxic


def test_quality_held_out():
    texts, good, _ = labelled(400, 1)
    model = quality.QualityModel(texts[:300], good[:300])
    scores = np.concatenate([model.scores(f, o) for _, _, f, o in chunks(pa.array(texts[300:]))])
    assert ((scores >= quality.THRESHOLD) == np.array(good[300:])).mean() >= 0.97
    assert quality.QualityModel(["a"], [1]).scores(np.zeros(0, np.uint8), np.zeros(2, np.int64)) == pytest.approx(2 / 3)


def test_toxicity_held_out_and_located():
    texts, _, toxic = labelled(600, 2)
    model = toxicity.ToxicityModel(texts[:450], toxic[:450])
    (_, _, flat, offsets), = chunks(pa.array(texts[450:]))
    scores, each, docs, begin, end = model.scores(flat, offsets)
    assert ((scores >= toxicity.THRESHOLD) == np.array(toxic[450:])).mean() >= 0.97
    data = flat.tobytes()
    for i in np.flatnonzero(each >= toxicity.OFFENDING):
        assert re.search(rb"idiotix|scumble|moronous", data[begin[i] : end[i]], re.I)


def test_toxicity_of_long_texts_in_pieces(monkeypatch):
    """A text in pieces has the sentences of a text read at once, also where a sentence or a word is longer than a piece."""
    texts, _, toxic = labelled(600, 2)
    model = toxicity.ToxicityModel(texts[:450], toxic[:450])
    rng = random.Random(3)
    parts = [t + rng.choice([". ", "\n", " ", "!?", "é ", "..", " idiotix, ", "z" * 90, " " * 80, ", " * 50]) for t in texts]
    for a in range(0, 600, 40):
        flat = np.frombuffer("".join(parts[a : a + 40]).encode(), np.uint8)
        offsets = np.array([0, len(flat)])
        whole = model.scores(flat, offsets)
        monkeypatch.setattr(toxicity, "PIECE", rng.choice([7, 64, 300]))
        assert len(list(toxicity.pieces(flat))) > 9
        found = model.scores(flat, offsets)
        monkeypatch.undo()
        assert all(np.array_equal(x, y) for x, y in zip(found[2:], whole[2:], strict=True))
        assert np.allclose(found[0], whole[0]) and np.allclose(found[1], whole[1])


def peak_bytes(call):
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_in_bounded_memory():
    """Fitting and scoring hold a few bytes for each byte of text, not the features of all words."""
    texts, _, toxic = labelled(400, 2)
    texts = pa.array([" ".join(WORDS) * 100 + t for t in texts])
    size = texts.nbytes
    assert size > 3e6
    toxicity.ToxicityModel(texts.slice(0, 20), toxic[:20])  # tables of powers
    assert peak_bytes(lambda: toxicity.ToxicityModel(texts, toxic)) < 7 * size
    flat = np.tile(np.frombuffer(b"some words of one. long text ", np.uint8), 400_000)
    assert peak_bytes(lambda: TOXIC.scores(flat, np.array([0, len(flat)]))) < 8 * len(flat) + 4e7


def test_quality_in_bounded_memory():
    """Scoring gathers the vectors of some words at a time, not those of a whole chunk."""
    (_, _, flat, offsets), *_ = chunks(pa.array([" ".join(WORDS[k % 7 :] * 10) for k in range(900)]))
    QUALITY.scores(flat, offsets)  # tables of powers
    assert len(flat) > 5e5 and peak_bytes(lambda: QUALITY.scores(flat, offsets)) < 36 * len(flat)


def test_models_are_fitted_by_a_task(spark):
    texts, good, _ = labelled(200, 4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, None), (None, "x"), (5, "z" * 900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(good)] + [(4, 1 - good[4]), (7, None), (None, 1), (999, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, 150, 800)
    assert len(rows) == 150 and all(len(t) <= 800 and y in (0, 1) for t, y in rows) and rows == labelled_sample(docs.repartition(3), labels, 150, 800)
    model = quality.fitted(docs, labels)
    assert model.network is not None
    nothing = quality.fitted(docs.limit(0), labels)
    assert nothing.network is None and nothing.share == 0.5


def labelled_sample(docs, labels, rows, chars):
    found = sample(docs, labels, "quality", F.lit(True), rows, chars).collect()
    return [tuple(r) for r in found]


# ---- 3 --------------------------------------------------------------------------------------------------------


def brute_components(rows, k=4):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("chunk", [None, 400])
def test_near_components(spark, monkeypatch, chunk):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 40, 90]))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    rows += [(200, None), (201, ""), (202, " "), (203, "one"), (204, "ONE")]
    if chunk:  # blocks cut into pairs of chunks
        monkeypatch.setattr(ngram_join.block_links, "__defaults__", (chunk, 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs).collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("few", [0, 10**6])
def test_near_components_of_repeated_rows(spark, monkeypatch, few):
    """Rows of equal ids and texts give their set once; sets come by broadcast or by shuffle."""
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", few)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:59], "x"])), (2, " ".join([*words[:59], "x"])), (None, " ".join(["y", *words[1:]])), (4, "other " * 3)]
    docs = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 57, 1), (2, 57, 1), (2, 57, 1), (None, 57, 1), (4, 1, 4)] * 2, key=str)


def shuffled_bytes(spark):
    """Of all stages so far, by the session's status store."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_are_shuffled_once(spark):
    """The sets of blocks of ordinary size go through one shuffle, to their jobs, also where no table is small enough for a broadcast."""
    rng = random.Random(3)
    rows = []
    for group in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        rows += [(3 * group + c, " ".join([*words[:c], f"x{c}", *words[c + 1 :]])) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        before = shuffled_bytes(spark)
        assert len({r.component_id for r in ngram_join.near_components(docs).collect()}) == 60
        # beside the sets of 8 bytes a shingle, their first shingles are counted and joined
        assert shuffled_bytes(spark) - before < 2.5 * 8 * 1497 * len(rows)
    finally:
        spark.conf.set(name, limit)


def test_near_copies_over_many_chunks(spark, monkeypatch):
    """One large group of near copies and outsiders at its edge, which only some of them link with."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2]) if i < 70 else rng.choice([2, 3])):
            w[rng.randrange(60)] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join.block_links, "__defaults__", (600, 8))
    monkeypatch.setattr(shared, "LOOKUP_ROWS", 0)  # the salted way
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs).collect()}
    assert found == brute_components(rows) and len({c for _, c in found.values()}) > 3


def test_divide_skip_with_known_sets():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        s = set(range(40)) - set(rng.integers(0, 40, rng.integers(0, 6)).tolist())
        sets.append(np.array(sorted(s | set((100 + rng.integers(0, 5, 2)).tolist())), np.int64))
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    quiet = np.array([alike(sets[0], x) for x in sets])
    known = np.where(quiet, 0, np.arange(60))
    links = ngram_join.divide_skip(sets, np.zeros(60, int), 85, known, quiet)

    def parts(pairs):
        label = list(range(60))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    inside = [(0, int(i)) for i in np.flatnonzero(quiet)]
    assert parts([*links, *inside]) == parts([(a, b) for a in range(60) for b in range(a) if alike(sets[a], sets[b])])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 3)
    rng = random.Random(6)
    edges = [(rng.randrange(12), rng.randrange(100)) for _ in range(70)] + [(500, i) for i in range(501, 520)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


# ---- 4 --------------------------------------------------------------------------------------------------------

NASTY = ["<|im_end|>", "<\\|x", "<\\\\|", "<|", "<<|<|", "a<", "|", "\\", "<|im_start|>user\nhi<|im_end|>\n", "é<|漢", ""]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c % 7 if c % 11 else None, c, rng.choice(["user", "assistant", "we\\ird\n<|", None]), rng.choice([None, *NASTY]) if rng.random() < 0.2 else "".join(rng.choices(NASTY, k=3))) for c in range(120)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("mask", F.lit("x"))
    parts = chat.format_chats(turns)
    said = defaultdict(list)
    for p in parts.orderBy("conv_id", "part").collect():
        data = p.formatted.encode()
        said[p.conv_id] += list(chat.parse(data))
        assert all(chat.OPEN not in data[m.start : m.end] and chat.CLOSE not in data[m.start : m.end] for m in p.mask)
    wanted = defaultdict(list)
    for conv, _, role, text in rows:
        wanted[conv].append(((role or "").encode(), (text or "").encode()))
    assert said == wanted
    for r in chat.digests(parts).collect():
        turns_ = wanted[r.conv_id]
        loss = b"".join(t for role, t in turns_ if role == b"assistant")
        assert r.turns_sha256 == hashlib.sha256(b"".join(a + b"\n" + b + b"\n" for a, b in turns_)).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns_), len(loss.decode()), hashlib.sha256(loss).hexdigest())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(none)).count() == 0


def test_chat_of_repeated_rows_and_a_long_text(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", "é<|" * 300_000), (2, 0, "assistant", None), (None, None, None, None), (1, 0, "assistant", "tie")]
    found = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()}
    assert (found[1].n_turns, found[1].loss_chars) == (4, 900_003) and (found[2].n_turns, found[2].loss_chars) == (1, 0)
    assert found[1].loss_sha256 == hashlib.sha256(b"tie" + "é<|".encode() * 300_000).hexdigest() and found[None].n_turns == 1


# ---- 5 --------------------------------------------------------------------------------------------------------


def brute_spans(text, k=4, slack=2, coverage=0.8, stretch=1.25):
    """(label, exact, start, end) by plain loops over templates and diagonals."""
    w, out = plain(text), []
    known = [(label, phrase, True) for label, phrase in licenses.BASE.items()] + [(label, t, False) for label, t in license_texts.TEXTS]
    for label, phrase, exact in known:
        q = plain(phrase)
        n = min(k, len(q))
        votes = defaultdict(list)
        for p in range(len(w) - n + 1):
            for t in range(len(q) - n + 1):
                if w[p : p + n] == q[t : t + n]:
                    votes[p - t].append((p, t))
        runs, last = [], None
        for d in sorted(votes):
            if exact or last is None or d - last > slack:
                runs.append([])
            runs[-1] += votes[d]
            last = d
        for run in runs:
            seen = {t for _, t in run}
            start, end = min(p for p, _ in run), max(p for p, _ in run) + n
            cover = len({t + j for t in seen for j in range(n)}) / len(q)
            if (len(seen) == len(q) - n + 1) if exact else (cover >= coverage and end - start <= -(-len(q) * stretch // 1) + slack):
                out.append((label, exact, start, end))
    return sorted(out)


def test_licenses(spark):
    rng = random.Random(3)
    phrases = [*licenses.BASE.values(), "CC-BY", "cc", "by", "general public"]
    rows = []
    for i in range(60):
        w = prose(rng, 30).split(" ")
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w)), rng.choice(phrases))
        text = rng.choice(license_texts.TEXTS)[1].split()
        for _ in range(rng.randint(0, 4)):  # words put in, left out and changed
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1])] = rng.choice([[], ["other"], ["one", "more"]])
        if i % 2:
            w[10:10] = text
        rows.append((i, " ".join(w)))
    rows.append((100, "x " + license_texts.TEXTS[0][1].replace("copy of this", "copy of just this") + " y"))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.template_grams(spark)).collect()}
    for i, t in rows:
        assert found[i].n_words == len(plain(t))
        assert sorted((s.label, s.exact, s.start, s.end) for s in found[i].spans) == brute_spans(t)
    assert {s.label for s in found[100].spans} == {"mit"}  # one word put in does not break it
    assert len({s.label for r in found.values() for s in r.spans}) > 6


# ---- 6 --------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long_ = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 40
    rows = [(1, "http://a/ b", long_), (2, None, None), (3, "u", ""), (4, "u", long_), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 100), (8, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    path = shared_dir(spark, "warc-test")
    warc.write_archives(pages, path, segment=50, chunk=16)
    found = warc.read_archives(spark, path)
    payloads = {int(r.page_id): bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert payloads == {i: h or "" for i, _, h in rows if i not in (4, 8)}
    kinds = {int(r.page_id): (r.payload_bytes, r.refers_to) for r in warc.resolved(found.drop("payload")).collect()}
    assert kinds[4] == (len(long_.encode()), "1") and kinds[8] == (100, "7") and kinds[6] == (5, None)
    assert next(r.url for r in found.where("page_id = 1").collect()) == "http://a/%20b"
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(good)] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(good.replace(b": 3", b": 2")))
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    nothing = shared_dir(spark, "warc-empty")
    warc.write_archives(pages.limit(0), nothing)
    assert warc.resolved(warc.read_archives(spark, nothing)).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_warc_of_repeated_and_absent_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "LOOKUP_ROWS", limit)
    body, other = "b" * 120, "c" * 300
    rows = [(1, "u", body), (1, "u", body), (1, "v", other), (2, "u", body), (3, "u", other), (None, "u", body), (None, None, other), (None, None, None)]
    path = shared_dir(spark, "warc-odd")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment=64, chunk=50)
    found = warc.read_archives(spark, path)
    assert found.count() == len({r.record for r in found.collect()}) == len(rows)
    got = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to or "") for r in warc.resolved(found.drop("payload")).collect())
    assert got == sorted([("1", 120, "response", ""), ("1", 120, "response", ""), ("1", 300, "response", ""), ("2", 120, "revisit", "1"), ("3", 300, "revisit", "1"), ("", 120, "response", ""), ("", 300, "response", ""), ("", 0, "response", "")])


# ---- 7 --------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 40)), "en", rng.choice(["a", "b", "b", "b", None, "c"]), 1) for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    places = [r.position for r in found if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()] == [tuple(r) for r in found]


def test_mixing_salted_and_with_texts(spark, monkeypatch):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", None]), 1) for i in range(120)], DOCS)
    plain_rows = [tuple(r) for r in mixing.mix(docs).collect()]
    monkeypatch.setattr(shared, "LOOKUP_ROWS", 0)
    found = mixing.mix(docs, texts=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [tuple(r)[:-1] for r in found.collect()] == plain_rows and all(r.text == texts[r.doc_id] for r in found.collect())


def test_mixing_levels_by_plain_loops(spark):
    """Targets against shares handed out until no source is above its cap."""
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(0, 9)), "en", rng.choice([None, *"abcdefgh"] + ["a"] * 20), 1) for i in range(400)]
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] >= 2 * size[s]}
        if not more:
            break
        full |= more
    found = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == pytest.approx({s: 2 * size[s] if s in full else level * weight[s] for s in names}) and full


def test_mixing_places_every_copy(spark):
    """Up to two rounds of one source: the middles of all stretches, end to end in one supply order, at their share of the demand."""
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(0, 30)), "en", "a", 1) for i in range(50)]
    for share in (0.3, 1.5, 1.9):
        found = mixing.mix(spark.createDataFrame(rows, DOCS), share).collect()
        target, total = found[0].target, found[0].source_size
        demand, at, wanted = int(target), 0, defaultdict(list)
        order = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
        for i, text, *_ in order * 3:
            took = min(len(text.split()), demand - at)
            if took > 0:
                wanted[i].append((at + took / 2) / target)  # the first source's schedule is level
            at += took
        assert target == pytest.approx(share * total) and at == demand
        assert {r.doc_id: r.positions for r in found} == {r[0]: pytest.approx(wanted[r[0]]) for r in rows}
        assert all(r.position == (r.positions or [None])[0] for r in found)
        assert max(max(r.positions, default=0) for r in found) > 0.9


# ---- 8 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lpc", [False, True])
def test_flac_round_trip(lpc):
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (64, 128, 1024, 1088, 5000)] + [b"\0" * 64, b"abc" * 3000, bytes(range(256)) * 40, (np.arange(9000) // 40).astype(np.uint8).tobytes(), (np.arange(9000) ** 2 // 9000).astype(np.uint8).tobytes()]
    offsets = np.cumsum([0, *map(len, rows)])
    streams = flac.encode(np.frombuffer(b"".join(rows), np.uint8), offsets, lpc)
    assert [x.tobytes() for x in flac.decode(streams)] == rows
    for at in (-1, -100, len(streams[6]) // 2):
        bad = bytearray(streams[6])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def bits(*fields):
    text = "".join(f"{value & ((1 << width) - 1):0{width}b}" for width, value in fields if width)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8)


def slow_crc(data, width, poly):
    r = 0
    for byte in data:
        r ^= byte << (width - 8)
        for _ in range(8):
            r = (r << 1) ^ poly if r >> (width - 1) else r << 1
            r &= (1 << width) - 1
    return r


def test_flac_of_another_writer():
    """Frames put together bit by bit: constant, verbatim, fixed of orders 1 and 3 in two partitions, linear of order 2, parameters of 5 bits."""
    rng = random.Random(2)
    walk = [0]
    while len(walk) < 64:
        walk.append(max(-100, min(100, walk[-1] + rng.randint(-9, 9))))
    rice = lambda v, k: [((v << 1 if v >= 0 else -2 * v - 1) >> k, 0), (1, 1), (k, (v << 1 if v >= 0 else -2 * v - 1))]

    def coded(residual, order, parts, method=0):
        out, size = [(2, method), (4, parts)], 64 >> parts
        for p in range(1 << parts):
            k = 2 + p
            out += [(4 + method, k), *(x for v in residual[max(order, p * size) - order : (p + 1) * size - order] for x in rice(v, k))]
        return out

    first = [b - a for a, b in zip(walk, walk[1:])]
    third = [walk[i] - 3 * walk[i - 1] + 3 * walk[i - 2] - walk[i - 3] for i in range(3, 64)]
    linear = [walk[i] - ((13 * walk[i - 1] - 5 * walk[i - 2]) >> 3) for i in range(2, 64)]
    warm = lambda n: [(8, v) for v in walk[:n]]
    frames = [
        ([(8, 0), (8, -7)], [-7] * 64),
        ([(8, 2), *((8, v) for v in walk)], walk),
        ([(8, 9 << 1), *warm(1), *coded(first, 1, 1)], walk),
        ([(8, 11 << 1), *warm(3), *coded(third, 3, 1, 1)], walk),
        ([(8, 33 << 1), *warm(2), (4, 5), (5, 3), (6, 13), (6, -5), *coded(linear, 2, 0)], walk),
    ]
    body, points, wanted = b"", b"", []
    for i, (fields, samples) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, 0x02, i]) + (63).to_bytes(2)
        data = head + bytes([slow_crc(head, 8, 0x07)]) + bits(*fields)
        points += (64 * i).to_bytes(8) + len(body).to_bytes(8) + (64).to_bytes(2)
        body += data + slow_crc(data, 16, 0x8005).to_bytes(2)
        wanted += samples
    raw = bytes(v & 0xFF for v in wanted)
    info = (64).to_bytes(2) * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | len(wanted)).to_bytes(8) + hashlib.md5(raw).digest()
    stream = b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(points).to_bytes(3) + points + body
    assert (flac.decode([stream])[0] ^ 0x80).tobytes() == raw


def test_flac_crc_values():
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8  # CRC-16 with polynomial 8005, nothing reflected


def test_flac_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 3000), (2, None), (3, "x" * 3000)], "doc_id long, text string")
    media = flac.to_media(docs)
    rows = {r.doc_id: r for r in flac.features(media).collect()}
    padded = b"x" * 3000 + b"\0" * 8
    assert rows[1].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[1].tail_crc32 == zlib.crc32(padded[-64:])
    assert rows[1][1:] == rows[3][1:] and (rows[2].n_bytes, rows[2].payload_bytes) == (0, 64)
    blocks = flac.pcm_blocks(media).where("doc_id = 1").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == padded and blocks[1].sample_offset == flac.BLOCK


# ---- 9 --------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_library_s():
    tokenizers = pytest.importorskip("tokenizers")
    library, counter = tokenizers.Tokenizer.from_file(tokens.default_path()), tokens.TokenCounter(tokens.default_path())
    rng = random.Random(1)
    pool = [*"aaaabAB ßÉé'sStTrRe1234٣½²ⅷΣΣσ\x1c\x85 😀漢字ÅﬁA<|>_-.\t\n\x00", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "ing", "the"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000, "<|endoftext|><|END"]
    assert counter.count(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


# ---- 10 -------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 7, 8, 9, 20, 30))] + [(10, None), (11, "!!"), (12, "the of and river stone light moves over")]
    rows = []
    for i in range(80):
        w = prose(rng, 25).split(" ")
        if rng.random() < 0.7:
            p = rng.choice(items)[1] or ""
            w[5:5] = p.upper().split(" ")[rng.randrange(3) :]
        rows.append((i, " - ".join(w)))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    found = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            q = words(text)
            n = min(8, len(q))
            for a in range(max(0, len(q) - 7) or (1 if q else 0)):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == q[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(str(item))
        assert (found[i].n_words, found[i].n_hit, found[i].hit_items) == (len(w), len(hit), sorted(ids))


@pytest.mark.parametrize("limit", [None, 0])
def test_decontamination_of_rows_without_id(spark, monkeypatch, limit):
    if limit is not None:  # shuffled joins instead of broadcasts, shingles in blocks
        for name, value in (("BROADCAST_FOUND", 0), ("BROADCAST_WINDOWS", 0), ("BROADCAST_SHINGLES", 2)):
            monkeypatch.setattr(decontam, name, value)
    leak, other = "one two three four five six seven eight", "nine ten eleven twelve"
    texts = [(None, f"x {leak} y"), (None, f"{other} z"), (None, "clean"), (None, None), (None, f"x {leak} y"), (7, leak), (7, other), (8, "clean"), (9, f"{leak} {other} {leak}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, leak), (2, other)], "item_id long, text string")
    order = lambda r: tuple(map(repr, r))
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in decontam.decontaminate(docs, items).collect()), key=order)
    held = lambda t: [str(k) for k, w in ((1, leak), (2, other)) if w in (t or "")]
    hit = lambda t: 8 * (t or "").count(leak) + 4 * (t or "").count(other)
    assert found == sorted(((i, len((t or "").split()), hit(t), held(t)) for i, t in texts), key=order)
    for most in (0, 1):
        kept = decontam.without_leaks(clashing(docs), items, most)
        assert kept.columns == clashing(docs).columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=order) == sorted(((i, t) for i, t in texts if len(held(t)) <= most), key=order)


# ---- shared ---------------------------------------------------------------------------------------------------


def test_shingles_of_every_length():
    (_, _, flat, offsets), = chunks(pa.array(["a b", "A  B", None, "a b c d e", "e d c b a", "a b c d a b c d"]))
    sets = [set(s.tolist()) for s in shingle_sets(flat, offsets, 4)]
    assert [len(s) for s in sets] == [1, 1, 0, 2, 2, 4] and sets[0] == sets[1] and not sets[3] & sets[4]


def test_written_rows_stay(spark):
    df = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    assert written(df, "t").count() == 10
