"""The registered queries themselves, and scores, links and recall against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import bpe, langid, linear, near_dedup, quality, queries, secrets, spans, token_counts, toxicity

RND = random.Random(11)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def held(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n == 0


LANGS = {"en": "the of and to in that was for with this from are have not but", "de": "der die und in den von zu das mit sich des auf ist im dem nicht", "fr": "le la les de des et que dans pour une est sur avec pas qui au", "es": "el los las de que en un por con para una su al lo como del"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder of tables with odd rows, and its rows."""
    at = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(f"bench{i}" for i in range(16))
    prose = lambda lang, n: " ".join(RND.choice(LANGS[lang].split()) for _ in range(n))
    rows = [(i, prose(lang, RND.randint(20, 60)) + RND.choice(["", ". You idiot, you scum! Go."]) * (i % 5 == 0), lang) for i, lang in enumerate(list(LANGS) * 60)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 !", "de"), (1003, "Token: abcdefgh12 AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2, "en"), (1004, item.upper() + " tail", "en"), (1005, item[:60], "fr"), (1006, "x " * 1500, None), (0, rows[0][1], "en"), (None, "null key the of and", "en")]
    spark.createDataFrame([(*r, "s", len(r[1] or ""), "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{at}/documents.parquet")
    labels = [(d, int("idiot" not in (t or "")), int("idiot" in (t or ""))) for d, t, _ in rows[:240]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item), (8, "tail " * 20), (10, item + " more"), (9, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, labels


def test_token_count_query(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t, _ in tables[1]:
        n = len(tok.encode(t or "", add_special_tokens=False))
        want.append((str(d), len((t or "").encode()), n, n > 1024))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, tables[0]).collect()) == sorted(want)
    assert any(w[3] for w in want)


def test_bpe_query(spark, tables):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t, _ in tables[1]:
        ids = enc.encode_ordinary(t or "")
        want.append((str(d), len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, tables[0]).collect()) == sorted(want)


def windows(w):
    n = min(13, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []


def test_decontamination_query(spark, tables):
    items = {7: " ".join(f"bench{i}" for i in range(16)), 8: "tail " * 20, 10: " ".join(f"bench{i}" for i in range(16)) + " more"}
    known = defaultdict(set)
    for i, t in items.items():
        for w in windows(WORD.findall(low(t))):
            known[w].add(str(i))
    want = []
    for d, t, _ in tables[1]:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for n in {len(k) for k in known}:
            for a in range(len(w) - n + 1):
                if found := known.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    ids |= found
        want.append((str(d), len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op5_winnowing_decontamination(spark, tables[0]).collect()]
    assert sorted(got) == sorted(want)
    assert ("1004", 17, 16, 2, sha("10,7"), True) in got


def test_secret_query(spark, tables):
    patterns = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}
    least = {"assign": 8, "access": 16, "hex": 32}
    want = []
    for d, t, _ in tables[1]:
        found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if len(m[1]) >= least[k]]
        count = Counter(k for _, _, k, _ in found)
        want.append((str(d), count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))))
    got = queries.op10_credential_linking(spark, tables[0]).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("name, cut", [("op2_string_kernel_toxicity", 0.5), ("op6_bradley_terry_quality", 0.3)])
def test_scoring_queries(spark, tables, name, cut):
    got = getattr(queries, name)(spark, tables[0])
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in tables[1])
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    label = {d: (q if name.startswith("op6") else t) for d, q, t in tables[2]}
    out = [r for r in got if r.held_out and r.doc_id in label]
    if name.startswith("op2"):
        assert out and np.mean([r.predicted == label[r.doc_id] for r in out]) > 0.95
    # A score is a function of the text alone.
    text = {d: t for d, t, _ in tables[1]}
    by = defaultdict(set)
    for r in got:
        by[text[r.doc_id] or ""].add(r.score)
    assert all(len(v) == 1 for v in by.values())


def test_labels_of_held_out_rows_change_nothing(spark, tables, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lab = spark.read.parquet(f"{tables[0]}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lab.withColumns({c: F.when(out, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}).write.parquet(f"{tmp_path}/labels.parquet")
    for f in (queries.op2_string_kernel_toxicity, queries.op6_bradley_terry_quality):
        assert sorted(f(spark, tables[0]).collect(), key=str) == sorted(f(spark, str(tmp_path)).collect(), key=str)


def slow_profile(t):
    x, counts = low(t).encode(), np.zeros(langid.FEATURES)
    for k in (1, 2, 3):
        for i in range(len(x) - k + 1):
            code = int.from_bytes(x[i : i + k], "big")
            cell = (((code * 2654435761 + k * 97) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
            counts[cell] += 1
    return np.sqrt(counts / max(1, counts.sum()))


def slow_language(m, t):
    """Families by margin, then votes of the pairs within, one text at a time."""
    x = slow_profile(t)
    margin = m.of_family @ x + m.family_bias
    family = int(np.argmax(margin))
    votes = Counter({i: 0.0 for i in m.families[family]})
    chance = Counter()
    for k, (i, j) in enumerate(m.pairs):
        p = 1 / (1 + np.exp(-3 * (m.of_pair[k] @ x + m.pair_bias[k])))
        if i in votes:
            votes[i if p >= 0.5 else j] += 1
            chance[i] += p
            chance[j] += 1 - p
    best = max(sorted(votes), key=lambda i: (round(votes[i], 9), round(chance[i], 9)))
    share = np.exp(3 * (margin - margin.max()))
    return m.langs[best], share[family] / share.sum() * (chance[best] / max(1, len(votes) - 1) if len(votes) > 1 else 1)


def test_language_query_is_its_models_one_text_at_a_time(spark, tables):
    d = spark.read.parquet(f"{tables[0]}/documents.parquet")
    m = langid.learnt(d.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0), "doc_id", "text", "lang")
    assert m.langs == sorted(LANGS) and sorted(i for g in m.families for i in g) == [0, 1, 2, 3]
    got = queries.op4_hierarchical_language_id(spark, tables[0]).collect()
    assert len(got) == len(tables[1]) and all(r.held_out == held(r.doc_id, 5) for r in got)
    text = defaultdict(set)
    for i, t, _ in tables[1]:
        text[i].add(t)
    for r in got:
        (t,) = text[r.doc_id]
        if not re.search(r"[^\W\d_]", t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        want, score = slow_language(m, t)
        assert r.lang_pred == want and r.score == pytest.approx(score, abs=1e-4)
    true = {i: lang for i, _, lang in tables[1][:240]}
    assert np.mean([r.lang_pred == true[r.doc_id] for r in got if r.held_out and r.doc_id in true]) > 0.95


def test_language_ties_go_to_the_first_name():
    zero = np.zeros((1, langid.FEATURES), np.float32)
    m = langid.Model(["a", "b", "c"], [[0, 1], [2]], np.zeros((2, langid.FEATURES)), np.zeros(2), [(0, 1)], np.zeros((1, langid.FEATURES)), np.zeros(1))
    assert m.predict(zero)[0].tolist() == [0]
    assert langid.fit(np.zeros((0, langid.FEATURES)), []) is None


def test_quality_features_and_scores_by_hand(spark, tables):
    texts = [t or "" for _, t, _ in tables[1]] + ["One two. One two.\nSAME LINE\nSAME LINE\n\n$$ %% tail", "a"]
    x = np.concatenate([quality.features(r) for r in spans.runs(pa.array(texts), 300)])
    for row, t in zip(x, texts, strict=True):
        b = t.encode()
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lw = [low(v) for v in w]
        lines = re.findall(r"[^\n]+", t)
        n = max(1, len(b))
        assert row[0] == pytest.approx(sum(97 <= c < 123 for c in b) / n) and row[1] == pytest.approx(sum(65 <= c < 91 for c in b) / n)
        types = len(set(lw)) / len(lw) if lw else 1
        lengths = [len(v.encode()) for v in w]
        assert row[17] == pytest.approx(np.log1p(np.mean(lengths) if w else 0)) and row[18] == pytest.approx(np.log1p(np.std(lengths) if w else 0), abs=1e-6)
        assert row[19] == pytest.approx(np.log1p(len(w))) and row[21] == pytest.approx(types)
        assert row[23] == pytest.approx(max(Counter(lw).values()) / len(lw) if lw else 0)
        pairs = [tuple(lw[i : i + 2]) for i in range(len(lw) - 1)]
        assert row[25] == pytest.approx(1 - len(set(pairs)) / len(pairs) if pairs else 0)
        assert row[31] == pytest.approx(1 - len(set(lines)) / len(lines) if lines else 0)
    lab = spark.read.parquet(f"{tables[0]}/labels.parquet")
    d = spark.read.parquet(f"{tables[0]}/documents.parquet")
    m = quality.learnt(d, lab, "doc_id", "text", "quality")
    got = {r.doc_id: r.score for r in quality.quality(d, lab).collect()}
    for (i, _, _), row in zip(tables[1], x, strict=False):
        z = sum(w * min(8.0, max(-8.0, (v - c) / s)) for w, v, c, s in zip(m.w, row, m.centre, m.scale, strict=True))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-((z - m.cut) / m.spread + np.log(0.3 / 0.7)))), rel=1e-6, abs=1e-9)


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """More documents of a label than the 2,000 that were sampled: centre, scale, weights and cut are those of all."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["plain", "Words", "here", "are", "many.", "$$", "!"], int(rng.integers(2, 12)))) for _ in range(5200)]
    y = [int(rng.random() < 0.5 + 0.4 * ("$$" not in t)) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    dealt, seen = quality.dealt, []
    monkeypatch.setattr(quality, "dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    m = quality.learnt(d, labels, "doc_id", "text", "quality")
    x, y = np.concatenate([quality.features(r) for r in spans.runs(pa.array(texts))]), np.array(y)
    assert m.centre == pytest.approx(x.mean(0)) and m.scale == pytest.approx(x.std(0) + 1e-9)
    rows = seen[0].collect()
    assert sum(r.once for r in rows) == len(texts)
    blocks = defaultdict(lambda: ([], []))
    for r in rows:
        blocks[r.block][r.y].append(m.scaled(np.frombuffer(r.x)))
    assert len(blocks) > 1 and all(a and b for a, b in blocks.values())
    diff = np.concatenate([g - np.array(bad) for bad, good in blocks.values() for g in good])
    assert np.abs(1e-3 * m.w - (diff / (1 + np.exp(diff @ m.w))[:, None]).mean(0)).max() < 1e-6
    raw = np.sort(m.scaled(x) @ m.w)
    low = int((y == 0).sum())
    assert m.cut == pytest.approx((raw[low - 1] + raw[low]) / 2) and m.spread == pytest.approx(max(1e-6, np.median(np.abs(raw - m.cut)) / 3))


def test_pairwise_fit_is_stationary_and_svm_keeps_its_type():
    rng = np.random.default_rng(0)
    d = rng.normal(size=(500, 4)) + [0.5, -0.2, 0, 0]
    w = linear.logistic(d, ridge=1e-3)
    grad = 1e-3 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
    assert np.abs(grad).max() < 1e-8
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] > 0, 1, -1)
    v, b = linear.svm(x, y)
    assert v.dtype == np.float32 and np.mean(np.sign(x @ v + b) == y) > 0.9


def slow_kernel(a, b):
    """Both strings' subsequences of ORDER bytes, by a plain table."""
    n, m = len(a), len(b)
    part = [[1.0] * (m + 1) for _ in range(n + 1)]
    total = 0.0
    for _ in range(toxicity.ORDER):
        new = [[0.0] * (m + 1) for _ in range(n + 1)]
        total = 0.0
        for i in range(n):
            row = 0.0
            for j in range(m):
                new[i + 1][j + 1] = toxicity.DECAY * new[i][j + 1] + row
                if a[i] == b[j]:
                    hit = part[i][j] * toxicity.DECAY**2
                    total += hit
                    row = toxicity.DECAY * row + hit
                    new[i + 1][j + 1] += 0.0
                else:
                    row = toxicity.DECAY * row
                new[i + 1][j + 1] = toxicity.DECAY * new[i][j + 1] + row
        part = [[0.0] * (m + 1)] + [r[:] for r in new[1:]]
        # part[i][j]: what ends before place i of a and before place j of b.
    return total


def test_bounds_drop_no_kernel():
    """10,000 pairs: the kernel cut at FLOOR, whole words against the definition."""
    rnd = random.Random(2)
    marks = [b"moronic", b"worthless", b"imbecile", b"idiot", b"scum", b"disgusting", "dämlich".encode(), b"aabbaabb", bytes(range(97, 117)), b"stupid"]
    words = [b"onic", b"rthle", b"imbe", b"idi0t"]
    while len(words) < 1000:
        m = bytearray(rnd.choice(marks))
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(m) + 1)
            m[i : i + rnd.randint(0, 2)] = bytes(rnd.choice(b"abcdeghilmnorstuw1") for _ in range(rnd.randint(0, 2)))
        words.append(bytes(m[: toxicity.LONGEST]))
    x, own = toxicity.letters(words), toxicity.own_kernel(toxicity.letters(words))
    full = [toxicity.Mark(m) for m in marks]
    size = np.array([len(w) for w in words])
    for m in full:
        value = toxicity.raw_kernel(x, m.mark) / np.sqrt(np.maximum(own * m.own, 1e-12))
        at, got = toxicity._likeness(x, size, toxicity.classes(x), m, np.full(len(x), -1.0, np.float32))
        out = np.zeros(len(x))
        out[at] = got
        sure = np.abs(value - toxicity.FLOOR) > 1e-4
        assert np.allclose(out[sure], np.where(value >= toxicity.FLOOR, value, 0)[sure], atol=1e-4)
    for w in words[:60]:
        for m in marks:
            a, b, c = slow_kernel(w, m), slow_kernel(w, w), slow_kernel(m, m)
            assert toxicity.raw_kernel(toxicity.letters([w]), m)[0] == pytest.approx(a, rel=1e-4, abs=1e-6)
            assert toxicity.own_kernel(toxicity.letters([w]))[0] == pytest.approx(b, rel=1e-4, abs=1e-6) and c > 0
    found = toxicity.kernels([b"x" * 20 + b"idiot" + b"x" * 20, b"onic", b"rthle", b"imbe"], [b"idiot", b"moronic", b"worthless", b"imbecile"])
    assert found[0, 0] == pytest.approx(1) and found[1, 1] > 0.35 and found[2, 2] > 0.25 and found[3, 3] > 0.25


def test_scores_are_those_of_the_worst_sentence(tables):
    rows = [(t, y) for (_, t, _), (_, _, y) in zip(tables[1], tables[2], strict=False)]
    m = toxicity.fit(rows, 0.2)
    texts = ["You idiot, you scum!", "the of and. you i d i o t now\nplain line", "calm words only", "", "x1", "an id-iot. sc.um"]
    got = np.concatenate([m.score(r) for r in spans.runs(pa.array(texts))])
    marks = [x.mark for x in m.marks]
    for t, s in zip(texts, got, strict=True):
        margin = m.b
        for sentence in re.split(r"(?<=[.!?])(?=\s)|\n", t):
            units = [re.sub(r"[^0-9a-z\x80-\U0010ffff]", "", low(u)) for u in sentence.split()]
            units, run, all_ = [u for u in units if u], [], []
            for u in [*units, "##"]:
                if len(u.encode()) == 1:
                    run.append(u)
                    continue
                all_ += ["".join(run)] if len(run) >= 3 else run
                run = []
                all_.append(u)
            words = [u.encode() for u in all_[:-1]]
            if words:
                k = toxicity.kernels(words, marks).max(0)
                if k.any():
                    margin = max(margin, float(k @ m.w + m.b))
        assert s == pytest.approx(1 / (1 + np.exp(-(m.a * margin + m.c))), rel=1e-4)
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.5
    for odd in ([("", 1), ("", 0)], [("a b", 1), ("c", 0)], [("calm words", 1), ("calm words", 0)], [(None, 1), ("plain words here", 0)]):
        assert all(0 <= v <= 1 for v in toxicity.fit(odd, 0.5).score(next(spans.runs(pa.array(["some text", ""])))))


def test_fits_take_texts_of_any_length(spark):
    long_ = "calm words here. " * 4000 + "you idiot. " + "calm words here. " * 4000
    d = spark.createDataFrame([(1, long_), (2, "calm words. " * 3000), (3, "x" * 50_000), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(d, labels).count() == quality.quality(d, labels).count() == 4
    m = quality.learnt(d, labels, "doc_id", "text", "quality")
    assert m is not None
    from panelforge.llm import base

    cut = {r["_k"]: r["_t"] for r in toxicity.sentences(base.picked(labels, d, "doc_id", "toxic", "text", 10)).collect()}
    assert cut[4] is None and all(0 < len(cut[i]) <= toxicity.FITTED for i in (1, 2, 3))


def test_samples_are_the_smallest_hashes_of_each_label(spark):
    from panelforge.llm import base

    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = d.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "rare").otherwise("hot").alias("y"))
    rows = base.few(base.hashed(base.picked(labels, d, "doc_id", "y", "text", 100)).collect(), 100)
    order = {r["_k"]: r["_o"] for r in base.hashed(labels.select(F.col("doc_id").alias("_k"))).collect()}
    hot = sorted((i for i in range(3000) if i % 50), key=lambda i: (order[i], i))[:100]
    assert [r["_k"] for r in rows] == sorted([*hot, *range(0, 3000, 50)])
    assert all(r["_t"] == f"t{r['_k']}" for r in rows)


def morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_complementary_two_letter_texts_are_told_apart(n):
    """Polynomials modulo 2**64 are the same for such a pair."""
    from tokenizers import Tokenizer

    one = morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(tok.encode(t, add_special_tokens=False)) for t in (one, two)]
    path = P.path("byte_bpe_50k.tiktoken")
    together = token_counts.count_column(pa.array([one, two]), P.path("byte_bpe_50k.json"))[1].tolist()
    apart = [int(token_counts.count_column(pa.array([t]), P.path("byte_bpe_50k.json"))[1][0]) for t in (one, two)]
    assert together == apart == want
    assert [b.decode() for _, b in bpe.encode_column(pa.array([one, two]), path, P.PATTERN)] == [one, two]
    assert [b.decode() for t in (two, one) for _, b in bpe.encode_column(pa.array([t]), path, P.PATTERN)] == [two, one]
    data = np.frombuffer((one + two).encode(), np.uint8)
    assert len(set(spans.hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2


def test_equal_hashes_of_different_spans_are_parted(monkeypatch):
    monkeypatch.setattr(spans, "hashes", lambda m, a, b: np.zeros(len(a), np.uint64))
    data = np.frombuffer(b"aabbaacab", np.uint8)
    a = np.array([0, 2, 4, 6, 7])
    codes, first = spans.distinct_spans(data, a, np.append(a[1:], 9))
    assert codes.tolist() == [0, 1, 0, 2, 3] and first.tolist() == [0, 1, 3, 4]


def test_memo_stays_within_its_bytes():
    memo = spans.Memo(20_000)
    for i in range(500):
        keys = [b"k%d" % j for j in range(i, i + 10)]
        assert memo.fill(keys, lambda new, keys=keys: [(keys[j] * 2, 10) for j in new]) == [k * 2 for k in keys]
        assert (len(memo.new) + len(memo.old)) * spans.ENTRY <= 20_000


def test_links_are_those_of_all_pairs():
    """within() against a look at every pair."""
    rnd = random.Random(4)
    for _ in range(200):
        make = lambda n: [(a, a + rnd.randint(1, 60), "x") for a in sorted(rnd.randint(0, 3000) for _ in range(n))]
        parts, others = make(rnd.randint(0, 12)), make(rnd.randint(0, 12))
        others += parts[:2]
        scope = [0, *sorted(rnd.sample(range(1, 3000), 3))]
        want = []
        for a, b, _ in parts:
            p = max(s for s in scope if s <= a)
            nxt = min((s for s in scope if s > a), default=1 << 62)
            want.append(any(o[1] > max(p, a - secrets.REACH) and o[0] < min(nxt, b + secrets.REACH) and o[:2] != (a, b) for o in others))
        assert secrets.within(parts, others, scope) == want


def test_recall_against_all_pairs_of_a_table(spark):
    """Links of all pairs of texts that share a shingle, at similarity 0.8 or more, over a whole table."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = d.collect()
    sets = {}
    for r in rows:
        w = WORD.findall(low(r.text))
        if w:
            sets[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    pairs = Counter((a, b) for ids in where.values() if len(ids) < 300 for n, a in enumerate(ids) for b in ids[n + 1 :])
    links = []
    for (a, b), n in pairs.items():
        x, y = sets[a], sets[b]
        if n >= 0.5 * max(len(x), len(y)):
            keys = set(x) | set(y)
            order = sorted(keys, key=lambda k: y.get(k, 0) / x[k] if k in x else np.inf)
            kx, ky = np.array([x.get(k, 0) for k in order], float), np.array([y.get(k, 0) for k in order], float)
            upto, beyond = np.cumsum(kx), ky.sum() - np.cumsum(ky)
            both = (kx > 0) & (ky > 0)
            if (1 / (upto[both] / kx[both] + np.maximum(beyond[both], 0) / ky[both])).sum() >= 0.8:
                links.append((a, b))
    cls = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()}
    assert len(links) > 50 and np.mean([cls[a] == cls[b] for a, b in links]) >= 0.999
    # And no class holds what no chain of links connects.
    up = {i: i for i in cls}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[find(a)] = find(b)
    assert len({find(i) for i in cls}) <= len(set(cls.values())) + sum(len(v) >= 300 for v in where.values())


def test_wide_buckets_are_dealt_into_narrow_ones(spark, monkeypatch):
    """Unlike documents that meet by one passage, near copies among them: fewer pairs are tried and no link is lost."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(100)]
    rows, want = [], {}
    for k in range(160):
        own = [f"u{rnd.randint(0, 10**6)}" for _ in range(40)]
        for copy in range(2 if k % 4 == 0 else 1):
            v = own[:-2] + [f"e{copy}{k}", "end"] if copy else own
            want[len(rows)] = k
            rows.append((len(rows), " ".join(passage + v)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, k in want.items():
        first.setdefault(k, i)
    levels, narrowed = [], near_dedup.narrowed

    def spy(rows, wide, nodes, level):
        levels.append(level)
        out = narrowed(rows, wide, nodes, level)
        before = rows.join(wide, "bucket").groupBy("bucket").count().agg({"count": "max"}).first()[0]
        after = out.join(rows.select("bucket").distinct(), "bucket", "left_anti").groupBy("bucket").count().agg({"count": "max"}).first()[0]
        assert out.join(wide, "bucket", "left_semi").isEmpty() and (level or after < before)
        return out

    monkeypatch.setattr(near_dedup, "narrowed", spy)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()} == {i: first[k] for i, k in want.items()} and not levels
    monkeypatch.setattr(near_dedup, "WIDE", 20)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(d).collect()} == {i: first[k] for i, k in want.items()}
    assert levels


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, a very long text and names that the stages use themselves."""
    import corpus_pipeline as C

    spark.createDataFrame([(1, "bench words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, node string, lang_pred string, score double, `key` string, grp int"
    rows = [(i, "the of and to " * 30 + f"w{i} x{i} y{i} z{i} " * 12, "en", "s", 1, 1, "n", "l", 0.5, "k", 2) for i in range(6)]
    rows += [(50, "le la les " * 100_000, "fr", "s", 1, 1, "n", "l", 0.5, "k", 2), (51, None, None, None, None, None, None, None, None, None, None), (52, "", "en", "s", 1, 1, "n", "l", 0.5, "k", 2)]
    for n, data in (("full", rows), ("empty", [])):
        docs = spark.createDataFrame(data, schema)
        for k, (name, stage) in enumerate(C.STAGES):
            path = f"{tmp_path}/{n}-{name}"
            out = stage(spark, docs, str(tmp_path))
            if k + 1 < len(C.STAGES):
                assert out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == ({*range(6), 50} if data else set())
