"""The training-data operators against plain versions, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("communis.llm")
import pyarrow as pa  # noqa: E402

from communis.llm import decontaminate, fingerprints, html, kneser_ney, language, packing, pii, secrets, simhash, toxicity, urls  # noqa: E402
from communis.llm.common import Tables, components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, row long, score double"


def sentence(r, n, words="the cat sat on a mat and saw the dog run far away from home over hill dale stone".split()):
    return " ".join(r.choice(words) + r.choice(["", "", str(r.randint(0, 40))]) for _ in range(n))


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, 7, 0.0) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [sentence(r, r.randint(1, 160)) for _ in range(30)]
    near = [b.replace("cat", "fox", 1) for b in base[:10]]
    return [None, "", " \n", "one", "one two", "Ünïcode ß 😀 text", "x" * 5000, *base, *near, base[3], base[3]]


def test_simhash_components(spark, texts):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(spark, docs_of(spark, texts)).collect()}
    prints = [simhash.fingerprint64(t) for t in texts]
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in prints]
    up = list(range(len(texts)))
    for _ in up:
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    up[i] = up[j] = min(up[i], up[j])
    assert [found[i]["component_id"] for i in range(len(texts))] == up


def test_simhash_hot_anchor_is_split(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    marks = sorted({base ^ sum(1 << r.randrange(64) for _ in range(2)) & (2**64 - 1) for _ in range(120)})
    signed = [x - 2**64 if x >= 2**63 else x for x in marks]
    df = spark.createDataFrame([(x, x) for x in signed], "node long, f0 long")
    t = Tables(spark, "test")
    found = simhash.components(t, simhash.links(t, df, ["f0"], 3, block=16))
    root = {r["node"]: r["root"] for r in found.collect()}
    up = {x: x for x in signed}
    for _ in range(8):
        for x, a in zip(signed, marks):
            for y, b in zip(signed, marks):
                if (a ^ b).bit_count() <= 3:
                    up[x] = up[y] = min(up[x], up[y])
    assert {x: root.get(x, x) for x in signed} == up


def test_components_of_a_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (90, 91)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(Tables(spark, "test"), df).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {91: 90}


def test_components_of_few_edges_are_those_of_rounds(spark, monkeypatch):
    """The few edges of one task take two tables, however long the paths; rounds, with hot nodes too, find the same."""
    from communis.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(40)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(180)] + [(-5, 7000), (7000, -5), (8000, 8000)]
    df, found = spark.createDataFrame(edges, "a long, b long").repartition(3), []
    for few in (common.FEW_EDGES, 0):
        t = Tables(spark, "test")
        found.append({x["node"]: x["root"] for x in components(t, df, few=few).collect()})
        assert few == 0 or t.n == 2
    assert found[0] == found[1] and found[0][300] == 0 and found[0][1039] == 1000 and found[0][7000] == -5 and 8000 not in found[0]
    assert components(Tables(spark, "test"), df.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each(spark, texts):
    r = random.Random(9)
    long = sentence(r, 400)
    close = " ".join(w if i != 200 else "other" for i, w in enumerate(long.split()))
    docs = docs_of(spark, [*texts, long, close, long], [*range(len(texts)), 500, 501, 500])
    kept = simhash.deduplicate(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids.count(500) == 1 and 501 not in ids and len(ids) == len(set(ids))
    assert {0, 3, 4, 5, 6} <= set(ids) and len(texts) - 1 not in ids  # null, empty and blank are one group
    assert simhash.deduplicate(spark, docs.limit(0)).count() == 0 and simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_deduplicate_keeps_clashing_columns_and_texts_of_equal_hash(spark):
    from pyspark.sql import functions as F

    r = random.Random(10)
    texts = [sentence(r, 40) for _ in range(12)] + [None]
    rows = [(i % 13, texts[i % 13], 5, 6, 7, f"{i:03}", {"k": i}) for i in range(39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, __node long, bit1 long, second string, `a b` map<string,int>").repartition(4)
    for hashed in (F.xxhash64, lambda c: F.length(c).cast("long") % 3):  # by length, different texts share a hash
        found = sorted(map(tuple, simhash.deduplicate(spark, docs, hashed=hashed).collect()))
        assert found == sorted(rows[i] for i in range(13))  # of repeats the least by the other columns


def test_a_hot_node_is_split(spark, monkeypatch):
    from communis.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    star = [(0, i) for i in range(1, 60)] + [(100 + i, 59) for i in range(20)] + [(200, 201)]
    found = {r["node"]: r["root"] for r in components(Tables(spark, "test"), spark.createDataFrame(star, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(1, 60), *range(100, 120)]} | {201: 200}
    docs = docs_of(spark, ["", None, " "] * 15 + ["one two three four"] * 9 + ["x"])
    rows = simhash.near_duplicates(spark, docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(55)) and {r["component_id"] for r in rows} == {0, 45, 54}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    docs = docs_of(spark, texts)
    tok = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack(spark, docs, length=64).collect()
    want, place = [], {}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in place.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    assert len(place) <= -(-sum(x[3] for x in want) // 64) * 1.2
    assert packing.pack(spark, docs.limit(0)).count() == 0


def best_fit_decreasing(sizes, length):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((x for x in gaps if x >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((length if fit is None else fit) - s)
    return len(gaps)


def test_matched_is_the_sweep():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        kinds = [rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        free, want = [], {}
        for i, k in enumerate(kinds):
            if k == 0:
                free.append(i)
            elif free:
                want[i] = free.pop()
        gaps, units = packing.matched(np.array(kinds, np.int64))
        assert dict(zip(units.tolist(), gaps.tolist())) == want


@pytest.mark.parametrize("parts", [1, 7])
def test_sweep_round_over_ranges_is_one_sweep(spark, parts):
    """Whatever the ranges, each unit gets the smallest gap that larger units have left."""
    rng = random.Random(parts)
    units = [(i, rng.randint(1, 30)) for i in range(300)] + [(1000 + i, 9) for i in range(200)]
    gaps = [(i, rng.randint(1, 40)) for i in range(200)] + [(1000 + i, 9) for i in range(90)]
    made, n = packing.sweep_round(Tables(spark, "test"), spark.createDataFrame(units, "unit long, size long"), spark.createDataFrame(gaps, "seq long, gap long"), parts)
    free, want = [], {}
    for size, kind, i in sorted([(-s, 1, i) for i, s in units] + [(-g, 0, i) for i, g in gaps]):
        if kind == 0:
            free.append(i)
        elif free:
            want[i] = free.pop()
    rows = made.collect()
    assert {r["unit"]: r["seq"] for r in rows if r["unit"] is not None and r["seq"] is not None} == want and n == len(want)
    assert sorted(r["unit"] for r in rows if r["unit"] is not None) == sorted(i for i, _ in units)
    assert sorted(r["seq"] for r in rows if r["seq"] is not None) == sorted(i for i, _ in gaps)


def test_packing_fills_like_best_fit_decreasing(spark):
    """Many sizes, a third of them one size, long texts of many sequences; ranges of few rows, so that they hand on."""
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(250)] + [0] * 150 + [63] * 20 + [rng.randint(100, 700) for _ in range(6)]
    docs = docs_of(spark, ["the " * n for n in sizes])
    rows = packing.pack(spark, docs, length=64, range_=40).collect()
    place = {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in place.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert sum(r["length"] for r in rows) == sum(n + 1 for n in sizes)
    assert len(place) <= 1.02 * best_fit_decreasing([r["length"] for r in rows], 64) + 1


def test_encoder_equals_tokenizer(texts):
    from tokenizers import Tokenizer

    odd = [*texts, "It's A.B., <|endoftext|> <|EndOfText|>", "É è İ ŉ Å e\u0301 \x1c \u3000 x\u2028y", "naïve, Straße. 12,5"]
    tok = Tokenizer.from_file(packing.vocabulary())
    assert [x.tolist() for x in packing.Encoder(packing.vocabulary())(pa.array(odd))] == [tok.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_decontamination(spark):
    r = random.Random(4)
    items = [(i, sentence(r, n)) for i, n in enumerate((12, 30, 30, 60))] + [(9, "only three words"), (10, None), (11, "?!")]
    texts = [None, "", *(sentence(r, 200) for _ in range(10))]
    texts += [f"{sentence(r, 40)} {items[k][1].upper()}! {sentence(r, 30)}" for k in range(4)] + [f"x {items[4][1]} y", items[1][1]]
    cut = items[3][1].split()
    texts.append(" ".join(["start", *cut[:30], "changed", *cut[31:], "end"]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    want = set()
    for d, t in enumerate(texts):
        words = decontaminate.words_of(t)
        for item, text in items:
            own = decontaminate.words_of(text)
            if own and words:
                goal = decontaminate.Counter(decontaminate.shingles(own, 5))
                if max(decontaminate.similarity(decontaminate.Counter(decontaminate.shingles(words[s : s + len(own)], 5)), goal) for s in range(max(1, len(words) - len(own) + 1))) >= 0.8:
                    want.add((d, item))
    found = decontaminate.leaks(spark, docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) >= 7
    kept = decontaminate.drop_leaks(spark, docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.leaks(spark, docs, bench.limit(0)).count() == 0


def test_secrets(spark):
    key, mixed = "AKIA" + "ABCD1234EFGH5678", "Zq3xT9bV1mK8sD2fG7hJ"
    texts = [None, "", f"a {key} b", "Password = 'hunter22' token:abc", "0123456789abcdef" * 2, f"user: bob pwd {mixed} at https://db.example.com/x", f"alone {mixed}", f"x {mixed} " + "far " * 200 + "user: bob", "api_key=" + "a" * 9 + " " + "secret: x" * 3, "😀 passwd=123456"]
    rows = {r["doc_id"]: r for r in secrets.scan(spark, docs_of(spark, texts)).collect()}
    base = [("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(base) for m in re.finditer(p, t or "") if ok(m))
        text = ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(rows[i]["spans"].split(","))
    assert rows[5]["spans"] == f"weak_access:0:9,weak_secret:14:{14 + len(mixed)},endpoint:{18 + len(mixed)}:{18 + len(mixed) + 24}"
    assert rows[6]["spans"] == "" and rows[7]["spans"] == ""
    assert secrets.scan(spark, docs_of(spark, texts).limit(0)).count() == 0


def test_fingerprints(spark, texts):
    ids = [*range(len(texts) - 2), len(texts) - 3, None]
    rows = fingerprints.compare_with_edited(spark, docs_of(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    order = sorted(zip(ids, (t or "" for t in texts)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    def sh(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = []
    for i, (doc, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), near(sh(t), sh(e)), near(sh(t), sh(nxt))))
    key = lambda x: repr(x[:3])
    found = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows), key=key)
    for x, y in zip(found, sorted(want, key=key)):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 0.16 and abs(x[4] - y[4]) < 0.16
    assert fingerprints.compare_with_edited(spark, docs_of(spark, texts).limit(0)).count() == 0


def test_fingerprints_do_not_depend_on_the_size_of_tasks(spark, texts, monkeypatch):
    """One range, and more ranges than rows: gaps between ids, negative, repeated and null ids."""
    docs = docs_of(spark, texts, [-5, None, *(3 * i for i in range(len(texts) - 3)), 3])
    rows = lambda: sorted((tuple(r) for r in fingerprints.compare_with_edited(spark, docs).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(fingerprints, "TASK_BYTES", 500)
    assert fingerprints._tasks(docs) > 20 and rows() == want
    monkeypatch.setattr(fingerprints, "_tasks", lambda docs: 1)
    monkeypatch.setattr(fingerprints, "RANGES", 1)
    assert rows() == want


def plain_kneser_ney(texts, order):
    """p(gram), by the textbook: absolute discounts, raw counts at the top, numbers of left neighbours below."""
    levels = {order: {}}
    for t in texts:
        for w in t.lower().split():
            p = " " * (order - 1) + w + " "
            for i in range(len(w) + 1):
                levels[order][p[i : i + order]] = levels[order].get(p[i : i + order], 0) + 1
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    cut = {}
    for k, level in levels.items():
        one, two = (sum(n == x for n in level.values()) for x in (1, 2))
        cut[k] = min(0.95, max(0.1, one / (one + 2 * two))) if one and two else 0.75

    def p(g):
        k = len(g)
        if not k:
            return 1 / 0x110000
        own = [n for x, n in levels[k].items() if x[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        return (max(levels[k].get(g, 0) - cut[k], 0) + cut[k] * len(own) * p(g[1:])) / sum(own)

    return p


def test_kneser_ney_is_the_textbooks_and_sums_to_one(spark):
    t = Tables(spark, "test")
    learned = {"x": ["banana bandana cab ab a", "banana Übung"], "y": ["cabs abba", "zzz"], "-": ["queer bandits", "a"]}
    rows = [(c, text) for c, some in learned.items() for text in some] + [(None, "nothing"), ("x", None), ("y", "")]
    counts = t.put(kneser_ney.count_grams(spark.createDataFrame(rows, "cls string, text string"), 3))
    found = kneser_ney.probabilities(t, t.put(kneser_ney.wide(counts, [["x"], ["y"], ["x", "y"]])), 3, 3).collect()
    assert {r["gram"] for r in found} == {(f"  {w} ")[i : i + 3] for some in learned.values() for text in some for w in text.lower().split() for i in range(len(w) + 1)}
    for i, some in enumerate((learned["x"], learned["y"], learned["x"] + learned["y"])):
        p = plain_kneser_ney(some, 3)
        assert all(abs(r[f"p{i}"] - p(r["gram"])) < 1e-9 for r in found)
        letters = sorted({c for text in some for c in text.lower()} | {" "})
        for head in ("ba", "an", "zz", " b", "qq"):
            assert abs(sum(p(head + c) for c in letters) + (0x110000 - len(letters)) * p(head + "\u4e00") - 1) < 1e-9


def test_toxicity_differences_are_the_models(spark):
    """Differences by word, from the labelled sample's arrays, against the whole models in plain form."""
    import numpy as np

    r = random.Random(13)
    texts = [sentence(r, 30) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    model, _ = toxicity.train(Tables(spark, "test"), docs, labels)
    from pyspark.sql import functions as F

    fold = {x["doc_id"]: x["f"] for x in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)).alias("f")).collect()}
    seen = [[texts[i] for i in range(9) if i % 2 == c and fold[i] > 0 and zlib.crc32(str(i).encode()) % 3 != 1] for c in (0, 1)]
    shared, tops = plain_kneser_ney(texts, 4), [plain_kneser_ney(x, 5) for x in seen]

    def top(c, g):
        level = {}
        for t in seen[c]:
            for w in t.lower().split():
                p = "    " + w + " "
                for i in range(len(w) + 1):
                    level[p[i : i + 5]] = level.get(p[i : i + 5], 0) + 1
        one, two = (sum(n == x for n in level.values()) for x in (1, 2))
        cut = min(0.95, max(0.1, one / (one + 2 * two))) if one and two else 0.75
        own = [n for x, n in level.items() if x[:-1] == g[:-1]]
        return (max(level.get(g, 0) - cut, 0) + cut * len(own) * shared(g[1:])) / sum(own) if own else shared(g[1:])

    assert tops and all(seen)
    words = ["cat", "mat", "zebra", "dog12", "ca"]
    for w, got in zip(words, kneser_ney.word_sums(pa.array(words), 5, model.value)):
        p = "    " + w + " "
        want = sum(np.log(top(1, p[i : i + 5]) / top(0, p[i : i + 5])) for i in range(len(w) + 1))
        assert abs(got - want) < 1e-4


def test_toxicity_learns_and_leaves_null_alone(spark):
    r = random.Random(6)
    bad = ["vilewort", "grubnose", "mudface"]
    texts, labels = [], []
    for i in range(240):
        t = sentence(r, r.randint(20, 60)).split()
        if i % 4 == 0:
            for _ in range(4):
                t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
        labels.append((i, int(i % 4 == 0), "x"))
    docs = docs_of(spark, [*texts, None, ""], [*range(240), 9000, None])
    lab = spark.createDataFrame([*labels, (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.score(spark, docs, lab).collect()
    assert len(rows) == 242 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in rows)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in rows)
    held = [x for x in rows if x["held_out"] and x["doc_id"] < 240]
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) >= 0.95 * len(held)
    assert toxicity.score(spark, docs, lab.limit(0)).agg({"score": "max"}).first()[0] == 0
    kept = toxicity.drop_toxic(spark, docs, lab)
    assert kept.columns == docs.columns and 150 <= kept.count() <= 190


def test_language(spark):
    r = random.Random(7)
    kinds = {"aa": "bala mana sarafa tala".split(), "oo": "gotto nolo pomo roso".split()}
    texts, langs = [], []
    for i in range(200):
        c = ("aa", "oo")[i % 2]
        texts.append(sentence(r, 25, kinds[c]))
        langs.append(c)
    rows = [(i, t, c, 1.0) for i, (t, c) in enumerate(zip(texts, langs))] + [(900, None, "aa", 1.0), (901, "12 !?", "oo", 1.0), (902, "", None, 1.0), (None, texts[0], None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = language.identify(spark, df).collect()
    by = {x["doc_id"]: x for x in found}
    assert all(by[i]["lang_pred"] == langs[i] for i in range(200)) and by[None]["lang_pred"] == "aa"
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= x["score"] <= 1 for x in found)
    assert language.identify(spark, df.limit(0)).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><title>no</title><script>x</script><h1>Head &amp; tail</h1><p>one <b>two</b><br>three<p>four
    <ul><li>a<li>b<ol start=3><li>c</ol></ul><table><tr><th>k<th>value<tr><td>long key<td>1</table><div hidden>no</div>
    <p style="display: none">no<pre>x
  y</pre><p>end"""
    assert html.render(page) == "Head & tail\n\none two\nthree\n\nfour\n\n- a\n- b\n  3. c\n\nk         value\nlong key  1\n\nx\n  y\n\nend"
    assert html.render(None) == html.render("") == "" and html.render("<div>" * 5000 + "deep") == "deep"
    df = spark.createDataFrame([(1, page, "t"), (1, page, "t"), (2, None, "u"), (None, "x", None)], "page_id long, html string, text string")
    rows = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()), key=repr)
    assert rows == sorted([(1, html.render(page), len(html.render(page)))] * 2 + [(2, "", 0), (None, "x", 1)], key=repr)
    assert html.extract(df.limit(0)).count() == 0


def test_html_tables_and_visibility():
    assert html.render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert html.render("<table><tr><td colspan=2>wide cell<td>x<tr><td>1<td>2<td>3</table>") == "wide cell  x\n1  2       3"
    assert html.render("<table><tr><td colspan=2000000>a<td>b<tr><td rowspan=0>c<td>d<tr><td>e</table>") == "a     b\nc  d\n   e"
    assert html.render("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>") == "日本   x\nabcde  y"
    assert html.render("<details><summary>more</summary>no</details><details open><summary>s</summary>yes</details>") == "more\ns\nyes"
    css = "<style>/* .a */ .no, p.gone {display : none} #id{visibility:hidden} @media print {.screen{display:none}} .b .c{display:none}</style>"
    assert html.render(css + "<p class='x no'>1<p class=gone>2<p id=id>3<p class=screen>4<div class=gone>5</div><b class=c>6</b>") == "4\n\n5\n6"


def test_html_takes_any_input_in_time_of_its_length():
    import time

    r = random.Random(17)
    bits = ["<![foo]>", "<![1 x", "<!", "<!--", "-->", "<", ">", "</", "&", "&#x;", "&amp", "<p>", "</p>", "<div>", "</div>", "<table>", "<tr>", "<td rowspan=3>", "<td colspan='x'>", "</table>", "<li>", "<ul>", "</ul>", "<style>a{", "</style>", "<script>", "</script>", "<?x", "x", " ", "\n", "<pre>", "<a b='", "'", "<details>", "<ol start=-9>", "<br/>", "\x00", "é"]
    for _ in range(400):
        assert isinstance(html.render("".join(r.choices(bits, k=r.randint(0, 60)))), str)
    assert html.render("<![foo]>x") == "x" and html.render("a<![CDATA[b]]>c") == "ac"
    assert html.render("1 < 2 <3 & &lt; &#65;&#x0042;&#" + "9" * 9000 + "; <b title='>'>x</b><!-- a > b -->y<!-->z<p a='b") == "1 < 2 <3 & < AB\ufffd xyz"
    assert html.render("<textarea>a<b>&amp;</textarea><script>a</b></script>c<svg/>d<IMG alt=x/>e</p>f") == "a<b>&cde\n\nf"
    for bit in ("<div>", "<p><span>", "<table><tr><td>", "<li>", "<b><p>", "</div>", "<dd>", "<blockquote>x", "<p><b>", "<tr><td>x", "<td rowspan=9>y", "&", "<br>", "<a ", "<a b='", '<a b="', "<!--", "<!", "</", "</a", "<?", "<", "<style>", "<script>", "<a b=c ", "<a/"):
        for last in ("", ">"):
            began = time.time()
            html.render("<p><table><td>" + bit * (200_000 // len(bit)) + last)
            assert time.time() - began < 30, bit


#: The contract's patterns, as it has them.
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def contract_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((i, m.start(), m.end()))
    return out


def test_pii(spark):
    texts = [None, "", "mail a.b@c.example.com, 10.0.0.1 and 999.1.1.1", "+1 (555) 555-2485, 4111 1111 1111 1111", "write to joe [at] mail (dot) example dot com now", "look at the dot", "call five five five one two three four five six seven", "ｊoe＠example．com", "pаul@example.com", "😀 x@y.zz", "a b@c.de " * 3000]
    rows = {r["doc_id"]: r for r in pii.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in contract_spans(t or ""))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(","))
    assert rows[2]["spans"] == "email:5:22,ip:24:32" and (rows[3]["n_card"], rows[3]["n_phone"]) == (1, 1)
    assert rows[4]["spans"] == f"email:9:{texts[4].index(' now')}" and rows[5]["spans"] == ""
    assert rows[6]["spans"] == f"phone:5:{len(texts[6])}"
    assert rows[7]["spans"] == f"email:0:{len(texts[7])}"
    assert rows[8]["spans"] == "email:0:16,email:2:16"
    assert pii.masked(texts[4]) == "write to <EMAIL> now" and pii.masked(None) is None
    out = pii.mask(docs_of(spark, texts))
    assert out.columns == docs_of(spark, texts).columns
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in out.collect())
    again = docs_of(spark, [texts[2]] * 3, [1, 1, None])
    assert sorted((r["doc_id"] is None, r["n_email"]) for r in pii.scan(again).collect()) == [(False, 1), (False, 1), (True, 1)]
    assert pii.scan(docs_of(spark, texts).limit(0)).count() == pii.mask(docs_of(spark, texts).limit(0)).count() == 0


def test_pii_base_spans_are_the_contracts():
    r = random.Random(18)
    bits = ["a", "Z9", ".", "@", "@", "-", "+", "+", " ", "  ", "1", "0", "255", "256", "4111111111111111", "(", ")", "x@y.z", "%", "é", "\n", "10.0.0.1"]
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert pii.base_spans(text) == contract_spans(text), text


def test_pii_takes_long_runs_in_time_of_their_length():
    import time

    zeros = "0" * 5000 + ".1.1.1"
    assert (1, 0, len(zeros)) in pii.base_spans(zeros)
    for text in ("1" * 10**6, "a" * 10**6 + " @", "a" * 10**6 + "@", "a@" * 300_000, "1." * 300_000, " " * 10**6 + "at", "[" * 300_000, "[ " * 300_000, "+1" * 300_000, "one " * 250_000, "one" * 250_000, "a@b" * 200_000, "a@b.c " * 100_000, "joe [at] x [.] y " * 20_000, " dot " * 150_000, "\u200b" * 300_000, "а" * 10**6, "0" * 10**6 + ".1.1.1", "1 dot " * 100_000):
        began = time.time()
        pii.disguised_spans(text, pii.base_spans(text))
        assert time.time() - began < 30, text[:20]


def test_pii_finds_disguises():
    for text, kind, part in (
        ("joe @ example.com", 0, None), ("joe@example·com", 0, None), ("joe@exam\u200bple.com", 0, None), ("j\u00adoe@example.com", 0, None), ("a.b.c.d.e.f.g.h [at] x.com", 0, None),
        ("10[.]0[.]0[.]1", 1, None), ("10 dot 0 dot 0 dot 1", 1, None), ("10.0(.)0.1", 1, None), ("plus one five five five one two three four five six seven", 3, None),
        ("five five five one two three four five six seven", 3, None), ("four one one one one one one one one one one one one one one one", 2, None), ("joe at example dot com", 0, None),
    ):
        whole = f"({text})"
        assert (kind, 1, 1 + len(text)) in pii.disguised_spans(whole, pii.base_spans(whole)), text
    for text in ("300[.]0[.]0[.]1", "one two three four five six", "we met at 5 and left", "l·lustre", "10.0.0.1"):
        assert pii.disguised_spans(text, pii.base_spans(text)) == [], text


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://A.Example.com/en/1?q": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "x://a.net/es/#f": ("a.net", "/es/", "net/es/", "block"),
        "x://net/fr/": ("net", "/fr/", "net/fr/", "block"), "x://anet/fr/": ("anet", "/fr/", None, "allow"), "x://com": ("com", "", None, "allow"),
        "x://example.com:80/en/": ("example.com:80", "/en/", None, "allow"), "x://a.org/ads/x": ("a.org", "/ads/x", None, "block"), "x://b.com/EN/": ("b.com", "/EN/", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    found = {r["page_id"]: tuple(r)[1:] for r in urls.judge(spark, df).collect()}
    assert list(found[i] for i in range(len(cases))) == list(cases.values())


def test_dedup_loses_no_candidate_to_a_forest(spark):
    """Texts of the same words in other orders have equal fingerprints, but are copies only of their own order."""
    r = random.Random(11)
    words, rows = [f"w{i}" for i in range(80)], []
    for family in range(9):
        order = r.sample(words, 80)
        for copy in range(2):
            rows.append((10 * family + copy, " ".join(order)))
            order[-1], order[-2] = order[-2], order[-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.deduplicate(spark, docs).collect()) == [10 * i for i in range(9)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_similar_across_joins_what_brute_force_joins(blocks):
    import numpy as np

    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(60)]
    sets = [sorted({*rng.sample(base, rng.randint(48, 60)), *(rng.getrandbits(64) for _ in range(rng.randint(0, 6)))}) for _ in range(60)]
    labels = np.array([rng.randint(0, 25) for _ in sets])
    nodes, prints = np.arange(len(sets)) * 7, [np.zeros(len(sets), np.uint64)]
    own = np.array([i % blocks for i in range(len(sets))])
    raw = [np.array(x, np.uint64).tobytes() for x in sets]

    def parts(pairs):
        up = {int(x): int(x) for x in labels}
        for a, b in pairs:
            x, y = up[int(labels[a])], up[int(labels[b])]
            up = {k: (x if v == y else v) for k, v in up.items()}
        return {frozenset(k for k in up if up[k] == v) for v in up.values()}

    near = [(i, j) for i in range(60) for j in range(i) if labels[i] != labels[j] and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.8]
    found = []
    for a in range(blocks):
        for b in range(a, blocks):
            at = np.flatnonzero((own == a) | (own == b))
            found += simhash.similar_across(nodes[at], labels[at], own[at] if a != b else None, [x[at] for x in prints], [raw[i] for i in at], 9, 0.8)
    links = [(int(a) // 7, int(b) // 7) for a, b in found]
    assert all((max(x), min(x)) in near for x in links) and near
    assert parts(links) == parts(near)


def test_dedup_finds_scattered_changes_in_texts_of_any_length(spark):
    """Pairs of five-word Jaccard similarity between 0.8 and 0.87, by fresh words far apart."""
    r = random.Random(21)
    rows = []

    def sh(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for family, n in enumerate([100, 150, 200, 300, 500, 800, 1500, 2500, 4000, 6000] * 5):
        words = [f"w{r.randrange(5000)}" for _ in range(n)]
        other, fresh = list(words), 0
        for at in range(20, n - 20, 55):
            other[at], fresh = f"fresh{family}x{at}", fresh + 1
        assert 0.8 <= len(sh(words) & sh(other)) / len(sh(words) | sh(other)) <= 0.93
        rows += [(10 * family, " ".join(words)), (10 * family + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x["doc_id"] for x in simhash.deduplicate(spark, docs).collect()) == [10 * i for i in range(50)]


def test_dedup_keeps_one_of_what_the_fingerprints_link(spark):
    """Texts whose fingerprints are within 3 bits are near copies by the method, if their shingles are too different for
    the second search: chains of them too. Texts of neither kind stay."""
    r = random.Random(23)
    rows, low = [], 0

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for family in range(6):
        head = " ".join(f"h{family}x{i}" for i in range(3))
        made = [" ".join([head] * 90 + [f"t{family}x{copy}x{i}" for i in range(60 + copy)]) for copy in range(3)]
        prints = [simhash.fingerprint64(t) for t in made]
        assert all((a ^ b).bit_count() <= 3 for a, b in zip(prints, prints[1:]))
        low += sum(len(sh(a) & sh(b)) / len(sh(a) | sh(b)) < 0.8 for a, b in zip(made, made[1:]))
        rows += [(10 * family + copy, t) for copy, t in enumerate(made)]
    rows += [(1000 + i, sentence(r, 30, [f"w{i}" for i in range(900)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {x["component_id"] for x in simhash.near_duplicates(spark, docs).collect()}
    assert low == 12 and sorted(x["doc_id"] for x in simhash.deduplicate(spark, docs).collect()) == sorted(want) == [0, 10, 20, 30, 40, 50, *range(1000, 1020)]


def test_decontamination_tries_windows_between_the_aligned_ones(spark):
    """Passages trimmed at both ends with words put in the middle are most like their item where no shingle is aligned."""
    r = random.Random(31)

    def fresh(n):
        return [f"v{r.randrange(10**6)}" for _ in range(n)]

    items, texts = [], ["", " ".join(fresh(300))]
    for n, trimmed, more in ((80, 2, 4), (100, 3, 6), (200, 8, 16), (400, 18, 36), (80, 5, 10), (100, 0, 0), (60, 1, 1)):
        own = fresh(n)
        cut = own[trimmed : n - trimmed]
        items.append((len(items), " ".join(own)))
        texts.append(" ".join([*fresh(50), *cut[: len(cut) // 2], *fresh(more), *cut[len(cut) // 2 :], *fresh(50)]))
        texts.append(" ".join([*cut[: len(cut) // 2], *fresh(more), *cut[len(cut) // 2 :]]))
    want = {}
    for d, t in enumerate(texts):
        words = decontaminate.words_of(t)
        for item, text in items if words else ():
            own = decontaminate.words_of(text)
            goal = decontaminate.Counter(decontaminate.shingles(own, 5))
            found = [(decontaminate.similarity(decontaminate.Counter(decontaminate.shingles(words[s : s + len(own)], 5)), goal), -s) for s in range(max(1, len(words) - len(own) + 1))]
            if max(found)[0] >= 0.8:
                want[d, item] = (max(found)[0], -max(found)[1], len(own))
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["similarity"], x["first_word"], x["words"]) for x in decontaminate.leaks(spark, docs, bench).collect()}
    assert got == want and {i for _, i in want} >= {0, 1, 2, 3, 5, 6}
    assert {x["doc_id"] for x in decontaminate.drop_leaks(spark, docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_pii_masks_whole_disguised_addresses():
    for text in ("joe@example[.]com", "joe@mail(.)example(.)com", "joe @ example.com", "joe dot smith@example.com", "joe at example {.} com", "joe at mail.2x.com", "joe[.]smith@example.com"):
        whole = f"so {text}, then" if " " not in text else f"({text})"
        start = whole.index(text)
        assert (0, start, start + len(text)) in pii.disguised_spans(whole, pii.base_spans(whole)), text
        assert pii.masked(whole) == whole.replace(text, "<EMAIL>")
    for text in ("sold at 3.50 each", "5 @ 2.25 or 4 at 10.30.", "released at v1.2", "a at b", "joe@example.com"):
        assert pii.disguised_spans(text, pii.base_spans(text)) == []


def test_secrets_of_any_length(spark):
    for n in (128, 129, 200, 3000):
        mixed = ("Zq3xT9bV1mK8sD2fG7hJ" * 150)[:n]
        row = secrets.scan(spark, docs_of(spark, [f"user: bob pwd {mixed} at https://db.example.com/x"])).first()
        end = 18 + n  # the scope is between starts
        assert row["spans"] == f"weak_access:0:9,weak_secret:14:{14 + n}" + (f",endpoint:{end}:{end + 24}" if n < 380 else "")


def linked_by_brute_force(text, scope=400):
    """All spans and links of a text, each part held against each."""
    python = [k[1].replace("(?i)", "") for k in secrets.KINDS]
    found = [(m.start(), k, m.end()) for k, p in enumerate(python) for m in re.finditer(p, text, re.I if secrets.KINDS[k][1].startswith("(?i)") else 0) if k or len(m[2]) >= 6]
    strong = [x for x in found if x[1] < 3]
    crosses = lambda x, some: any(y != x and y[0] < x[2] and x[0] < y[2] for y in some)
    ends = [x for x in found if x[1] == 5]
    weak = sorted(x for x in found if x[1] in (3, 4) and not crosses(x, strong + ends))
    weak = [x for i, x in enumerate(weak) if all(y[2] <= x[0] for y in weak[:i])]
    parts = sorted(strong + [x for x in ends if not crosses(x, strong)] + weak)
    role = lambda x: secrets.KINDS[x[1]][2]
    say = lambda x: f"{secrets.KINDS[x[1]][0]}:{x[0]}:{x[2]}"
    spans, links = [], []
    for x in parts:
        near = {r: min(((abs(y[0] - x[0]), y[1], y[0], y[2]) for y in parts if y != x and role(y) == r and abs(y[0] - x[0]) <= scope), default=None) for r in secrets.ROLES}
        name = {r: n and say((n[2], n[1], n[3])) for r, n in near.items()}
        if x[1] == 4:
            to = name["identifier"] or name["endpoint"]
        elif x[1] == 5:
            to = name["identifier"] and name["secret"] and f"{name['identifier']}&{name['secret']}"
        else:
            to = name["secret"]
        if x[1] < 3:
            spans.append(say(x))
        elif to:
            spans.append(say(x))
            links.append(f"{say(x)}>{to}")
    return ",".join(spans), ",".join(links)


def test_secrets_link_what_brute_force_links(spark):
    r = random.Random(12)
    kinds = [lambda: "AKIA" + "".join(r.choices("ABC123", k=16)), lambda: f"password={r.randint(10**5, 10**9)}", lambda: f"user: bob{r.randint(0, 9)}", lambda: "Zq3xT9bV1mK8" + str(r.randint(10**9, 10**10)), lambda: f"https://h{r.randint(0, 99)}.example.com/some-long-path-of-{r.randint(10**5, 10**6)}", lambda: "%032x" % r.getrandbits(128)]
    texts = ["see https://example.com/articles/some-long-slug-2024", "https://a.b/Zq3xT9bV1mK8sD2fG7hJ user: x", "😀 user: bob " + "Zq3xT9bV1mK8sD2fG7hJ"]
    for _ in range(60):
        texts.append(" ".join(r.choice(kinds)() if r.random() < 0.12 else r.choice(["far", "away", "word " * r.randint(1, 40)]) for _ in range(r.randint(1, 80))))
    texts += [texts[5], texts[5]]
    rows = secrets.scan(spark, docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row["spans"], row["links"]) == linked_by_brute_force(texts[row["doc_id"]])
    assert sum(r["n_linked"] for r in rows) > 30 and rows and {r["doc_id"]: r["spans"] for r in rows}[0] == ""


def test_language_is_calibrated_on_every_text_by_models_that_have_not_seen_it(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(sentence(r, r.randint(5, 20)), "en") for _ in range(20)] + [(sentence(r, 20, ["bala", "mana", "tala"]), "aa") for _ in range(4)] + [("12 !?", "aa"), ("queer text", None)]
    rows += [rows[0]] * 10
    docs = spark.createDataFrame(rows, "text string, lang string")
    usual = language.Models(Tables(spark, "test"), docs).usual
    fold = {x["text"]: x["f"] for x in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    for c in ("en", "aa"):
        h = []
        for f in (0, 1):
            p = plain_kneser_ney([t for t, lang in rows if lang == c and fold[t] != f], 4)
            for t in [t for t, lang in rows if lang == c and fold[t] == f and t != "12 !?"]:
                grams = [(f"   {w} ")[i : i + 4] for w in t.lower().split() for i in range(len(w) + 1)]
                h.append(-sum(np.log(p(g)) for g in grams) / len(grams))
        assert np.allclose(usual[c], (np.mean(h), max(np.std(h), 0.05)), atol=1e-4)


def test_language_by_joins_is_that_by_arrays(spark):
    """Repeated, empty, null and long texts, null ids and langs: the same rows whether models are sent or joined."""
    r = random.Random(14)
    rows = [(i, sentence(r, r.randint(1, 60), ["bala", "mana", "x9"] if i % 2 else ["gotto", "nolo"]), "ab"[i % 2]) for i in range(40)]
    rows += [(100 + i, rows[0][1], "a") for i in range(20)] + [(200, None, "a"), (201, "", "b"), (202, "12", None), (None, "mana gotto", None), (203, "bala " * 5000, None), (203, "bala " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    one, two = (sorted(language.identify(spark, docs, most).collect(), key=repr) for most in (1 << 20, 0))
    assert len(one) == len(rows) == len(two)
    for x, y in zip(one, two):
        assert (x["doc_id"], x["held_out"], x["lang_pred"], x["rejected"]) == (y["doc_id"], y["held_out"], y["lang_pred"], y["rejected"]) and abs(x["score"] - y["score"]) < 1e-6




def test_decontamination_finds_rotated_and_scattered_items(spark):
    """Items turned round, with words put in, left out and changed: whatever brute force over all windows finds."""
    r = random.Random(32)
    items = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(n))) for i, n in enumerate((40, 60, 60, 90, 150))]
    texts = []
    for i, (_, text) in enumerate(items):
        own = text.split()
        for turn in (0, 5, 10, len(own) // 2):
            w = own[turn:] + own[:turn]
            for edits in (0, 1, 2):
                x = list(w)
                for _ in range(edits):
                    at = r.randrange(len(x))
                    x[at : at + r.randint(0, 1)] = [f"new{r.randrange(10**6)}"] * r.randint(0, 2)
                texts.append(" ".join([f"o{r.randrange(10**6)}" for _ in range(r.randint(0, 30))] + x + [f"o{r.randrange(10**6)}" for _ in range(r.randint(0, 30))]))
    want = set()
    for d, t in enumerate(texts):
        words = decontaminate.words_of(t)
        for item, text in items:
            own = decontaminate.words_of(text)
            goal = decontaminate.Counter(decontaminate.shingles(own, 5))
            if max(decontaminate.similarity(decontaminate.Counter(decontaminate.shingles(words[s : s + len(own)], 5)), goal) for s in range(max(1, len(words) - len(own) + 1))) >= 0.8:
                want.add((d, item))
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(spark, docs, bench).collect()} == want and len(want) >= 40
    assert decontaminate.drop_leaks(spark, docs.limit(0), bench).count() == 0 and decontaminate.drop_leaks(spark, docs, bench.limit(0)).count() == len(texts)


def test_fingerprints_merge_and_estimate(spark):
    """Sketches of parts merge into that of the whole; beyond k shingles, estimates are near the truth."""
    from pyspark.sql import functions as F

    r = random.Random(33)
    a, b = ([f"w{r.randrange(300)}" for _ in range(900)] for _ in range(2))
    b[:600] = a[:600]
    rows = [(" ".join(a), " ".join(b), " ".join(a[:500]), " ".join(a[496:]))]
    df = spark.createDataFrame(rows, "a string, b string, x string, y string").select(*[fingerprints.words(F.col(c)).alias(c) for c in "abxy"])
    df = df.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abxy"])
    df = df.withColumns({"ab": fingerprints.merged(F.col("a"), F.col("b")), "xy": fingerprints.merged(F.col("x"), F.col("y"))})
    c = {n: F.col(n) for n in ("a", "b", "ab", "xy")}
    row = df.select("a", "xy", fingerprints.resemblance(c["a"], c["b"], c["ab"]).alias("j"), fingerprints.distinct_shingles(c["a"]).alias("n"), fingerprints.containment(c["a"], c["b"], c["ab"]).alias("c")).first()
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    p, q = sh(a), sh(b)
    assert row["a"] == row["xy"] and len(row["a"]) == 128
    assert abs(row["j"] - len(p & q) / len(p | q)) < 0.13 and abs(row["n"] / len(p) - 1) < 0.3 and abs(row["c"] - len(p & q) / len(p)) < 0.25


def test_pipeline_from_end_to_end(spark, tmp_path):
    """What stays and how it is cut, against plain versions of the stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    r = random.Random(34)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ga", "he", "lo", "mi") for b in ("ran", "sel", "tim", "vor", "nux", "pell", "dar")]
    items = [(i, sentence(r, 40, words)) for i in range(3)]
    texts = []
    for i in range(120):
        t = sentence(r, r.randint(30, 60), words).split()
        if i % 4 == 0:
            for _ in range(5):
                t.insert(r.randrange(len(t)), r.choice(["vilewort", "grubnose", "mudface"]))
        texts.append(" ".join(t))
    texts[1] += " write to joe [at] example (dot) com or 10.0.0.1"
    texts += [texts[5], texts[5], texts[7] + " end", f"{sentence(r, 20, words)} {items[1][1]} {sentence(r, 20, words)}", None, "", sentence(r, 6000, words)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    toxic = {x["doc_id"] for x in toxicity.score(spark, docs, labels).collect() if x["predicted"]}
    assert sum(i % 4 == 0 for i in toxic) >= 28 and sum(i % 4 > 0 for i in toxic) <= 2
    sh = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    stay = []
    for i, t in enumerate(texts):
        if i not in toxic and all(len(sh(t) & sh(texts[j])) / len(sh(t) | sh(texts[j])) < 0.8 for j in stay):
            stay.append(i)
    for item, text in items:
        stay = [i for i in stay if " ".join(decontaminate.words_of(text)) not in " ".join(decontaminate.words_of(texts[i] or ""))]
    tok = Tokenizer.from_file(packing.vocabulary())
    want = []
    for i in stay:
        ids = tok.encode(pii.masked(texts[i]) or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + 4096]))) for k, s in enumerate(range(0, len(ids), 4096))]
    assert "<EMAIL>" in pii.masked(texts[1]) and 123 not in stay
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(x)[:5] for x in rows) == want


def test_words_of_texts_that_end_in_blanks(monkeypatch):
    from communis.llm import words

    r = random.Random(1)
    kinds = [None, "", " ", "  ", "q ", " q", "zz\n", "a b", "ÀB c\n", " ", "x" * 50]
    for slice_ in (1, 7, 1 << 20):
        monkeypatch.setattr(words, "SLICE", slice_, raising=False)
        for _ in range(700):
            texts = [r.choice(kinds) for _ in range(r.randint(1, 6))]
            found = []
            for w, codes, ends in words.encode_words(pa.array(texts, pa.string()), most=r.choice([1, 20, 8 << 20])):
                found += [[w[int(k)].as_py() for k in codes[a:b]] for a, b in zip([0, *ends[:-1]], ends)]
            assert found == [(t or "").lower().split() for t in texts]


def test_working_memory_of_a_batch_stays_a_few_times_its_size():
    import tracemalloc

    from communis.llm.words import encode_words

    r = random.Random(2)
    texts = [sentence(r, 600) for _ in range(2400)]
    array = pa.array(texts)
    size = array.nbytes
    assert size > 6 << 20
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        for _ in encode_words(array):
            pass
    finally:
        pa.set_memory_pool(before)
    assert pool.max_memory() < 3 * size
    for work in (lambda: simhash.shingle_bins(array, 5), lambda: simhash._bands(5, 69)(pa.RecordBatch.from_pydict({"node": range(len(texts)), "text": array})), lambda: simhash.fingerprints64(texts)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5 * size


def test_packing_cuts_and_groups_in_one_worker(spark, texts, monkeypatch):
    passes = []
    put = Tables.put
    monkeypatch.setattr(packing.Tables, "put", lambda self, df: passes.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")) or put(self, df))
    assert packing.pack(spark, docs_of(spark, texts)).count() >= len(texts)
    assert passes[0] == 1


def test_packing_of_one_range_takes_its_rounds_in_one_task(spark, monkeypatch):
    rng = random.Random(6)
    docs = docs_of(spark, ["the " * rng.randint(0, 62) for _ in range(300)])
    rounds = []
    by_table = packing.sweep_round
    monkeypatch.setattr(packing, "sweep_round", lambda *x: rounds.append(x[-1]) or by_table(*x))
    few = packing.pack(spark, docs, length=64).collect()
    assert not rounds
    many = packing.pack(spark, docs, length=64, range_=40).collect()
    assert rounds and sorted(r[:5] for r in few) == sorted(r[:5] for r in many)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_in_one_task_give_the_rows_of_rounds_by_table(spark, seed):
    rng = random.Random(seed)
    units = spark.createDataFrame([(i, rng.choice([9, rng.randint(1, 64)])) for i in range(150)], "unit long, size long")
    gaps = spark.createDataFrame([(i, rng.choice([64, 64, rng.randint(1, 64)])) for i in range([40, 90, 1][seed])], "seq long, gap long")
    found = []
    for range_ in (1 << 16, 100, 20):  # all in one task, the last rounds, few or none
        placed, free, n = packing._fill(Tables(spark, "test"), units, gaps, 150, 64, range_)
        found.append((sorted(tuple(r) for p in placed for r in p.select("unit", "seq", "offset").collect()), sorted(tuple(r) for r in free.select("seq", "gap").collect()), n))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 150 - found[0][2]


def test_encoder_takes_words_of_letters_together():
    import sys

    from tokenizers import Tokenizer

    r = random.Random(7)
    words = ["".join(r.choice("abcdeéößÀĳSTUVWXYZ") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", ",", "!!", ".###", "'", "&$"]) for _ in range(6000)]
    encoder = packing.Encoder(packing.vocabulary(), most=2500)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "call"

    texts = [" ".join(words[i : i + 2000]) for i in range(0, 6000, 2000)]
    sys.setprofile(count)
    try:
        got = [x.tolist() for t in texts for x in encoder(pa.array([t]))]
    finally:
        sys.setprofile(None)
    assert calls[0] < 2000
    tok = Tokenizer.from_file(packing.vocabulary())
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_composes_before_it_lowers():
    """W and a ring are two letters, w and a ring are one; the tokenizer composes first."""
    from tokenizers import Tokenizer

    odd = ["W\u030a w\u030a J\u030c, Y\u030a. H\u0331a T\u0308 E\u0301", ". , .. ,, a. b, a., a.b É. it's it' 's x\x00 \x01, é\x7f a&&é b<| &a& a1. 1a ª º \u1e9e ß. ǅ Ⱥ, \u0250. x\u0250"]
    tok = Tokenizer.from_file(packing.vocabulary())
    for some in (odd, odd[1:]):
        assert [x.tolist() for x in packing.Encoder(packing.vocabulary())(pa.array(some))] == [tok.encode(t, add_special_tokens=False).ids for t in some]
