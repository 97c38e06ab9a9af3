"""The numbered problems on small fixtures: brute force, or cases with a known answer; nulls, empty tables and clashing columns."""

import collections
import itertools
import json
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordscope.llm import p1_copies, p2_cut, p3_versions, p4_splits, p5_pairs, p7_leaks, p8_mix, p9_lookalikes
from recordscope.llm.bitslice import close_pairs, close_to_leader
from recordscope.llm.canon import canonical_text
from recordscope.llm.visual import pair_scores, visual_form
from recordscope.session import table
from tests.conftest import rows

CLASH = {"digest": "x", "form": "x", "rep": "x", "token": "x", "n": "x", "copies": "x", "keep_id": "x", "set_id": "x", "state": "x", "unit": "x", "defect": "x"}


def clashing(df):
    """The table with further columns that are named like the operators' own."""
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


def frame(spark, schema, data):
    return clashing(spark.createDataFrame(data, schema))


# --- 1 and 3 -----------------------------------------------------------------------------------------------------------

SAME = [
    ('Read it.\n\nFIELDS:\n- b: x, y.\n- a: z\nDone {"q": [1, 2], "p": {"y": "A", "x": null}}', 'READ  IT\nfields\na: z\n\nb: X; y\ndone\n{"p":{"x":null,"y":"a"},"q":[1,2]}'),
    ('{"a": "x\\ny: 1\\nz: 2"}', '{ "a" : "X z: 2\\ny: 1" }'),
    ("{schema} a-b", "{SCHEMA}\n\ta b!"),
    ("Straße 5", "STRASSE (5)"),
]
OTHER = [("rule one\nrule two", "rule two\nrule one"), ('{"a": [1, 2]}', '{"a": [2, 1]}'), ("ab", "a b"), ('{"a": 1.0}', '{"a": 1}'), ("cafe", "café")]


def test_canonical_form():
    assert canonical_text(SAME[0][0]) == canonical_text(SAME[0][1])
    for a, b in [*SAME[2:], SAME[0]]:
        assert canonical_text(a) == canonical_text(b), (a, b)
    for a, b in OTHER:
        assert canonical_text(a) != canonical_text(b), (a, b)
    assert canonical_text('{"a": [') == "a" and canonical_text("") == "" and canonical_text('{"a": ' * 3000)


PROMPTS = "record_id bigint, prompt string, prompt_hash string"


def brute_copies(data):
    groups = collections.defaultdict(list)
    for i, p, *_ in data:
        if i is not None and p is not None:
            groups[canonical_text(p)].append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def prompts(n=400):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 60)) for _ in range(40)) for _ in range(30)]
    out = [(None, "x", None), (9000, None, None), (9001, "", None), (9002, " !", None), (9003, "one two", None), (9004, "one, two", None), (9005, "long " * 30_000, None)]
    for i in range(n):
        words = (base[0] if i % 3 == 0 else rng.choice(base)).split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 9])):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
        text = rng.choice([" ", "  ", ", "]).join(words)
        out.append((i, text.upper() if rng.random() < 0.3 else text, None))
    return out


def test_copies(spark):
    data = prompts()
    df = frame(spark, PROMPTS, data)
    assert rows(p1_copies.p1_found(df)) == sorted(brute_copies(data), key=repr)
    out = p1_copies.p1_distinct(df).collect()
    assert sum(r["copies"] for r in out) == sum(p is not None and i is not None for i, p, _ in data)
    assert rows(p1_copies.p1_found(df.limit(0))) == [] and rows(p1_copies.p1_distinct(df.limit(0))) == []


def test_filter_grows_with_the_records(spark, monkeypatch):
    """Every repeat passes a filter of several passes, and few singletons do."""
    data = [(i, f"w{i % 15000}" if i < 30_000 else f"s{i}", None) for i in range(60_000)]
    keys = p1_copies.digests(spark.createDataFrame(data, PROMPTS)).repartition(20).cache()
    monkeypatch.setattr(p1_copies, "PASS_SEGMENTS", 3)
    monkeypatch.setattr(p1_copies, "CHUNK", 1000)
    marked = p1_copies.mark_repeats(keys, 60_000)
    repeats, singles = marked.where("record_id < 30000"), marked.where("record_id >= 30000")
    assert repeats.where("maybe_repeat").count() == 30_000 == singles.count()
    assert singles.where("maybe_repeat").count() < 600
    assert p1_copies.repeat_filter(keys, 60_000)[1] == 11 and p1_copies.repeat_filter(keys, 120_000)[1] == 22


def test_stale_hashes(spark):
    import hashlib

    good = hashlib.sha256(b"a b").hexdigest()[:16]
    df = frame(spark, PROMPTS, [(1, "a b", good.upper()), (2, "A b", good), (3, "a-b", ""), (4, "c", None)])
    assert rows(p1_copies.p1_distinct(df).select("record_id", "copies", "saved_hashes", "stale_hashes")) == [(1, 3, 2, 1), (4, 1, 0, 0)]
    again = frame(spark, PROMPTS, [(1, "a b", good), (1, "a  b", good), (2, "A b", "x")])
    assert rows(p1_copies.p1_distinct(again)) == [(1, 3, 3, 2)]


def test_versions(spark):
    data = prompts()
    sets, parent = {}, {}
    for i, p, _ in data:
        if i is not None and p is not None:
            parent[i], sets[i] = i, (canonical_text(p), set(p3_versions.sequences(p).tolist()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        (ca, sa), (cb, sb) = sets[a], sets[b]
        if ca == cb or sa and sb and 10 * len(sa & sb) >= 7 * len(sa | sb):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = frame(spark, PROMPTS, data)
    assert rows(p3_versions.p3_found(df)) == sorted(((root(i), i) for i in sets if root(i) != i), key=repr)
    assert rows(p3_versions.p3_found(df.limit(0))) == []


def test_versions_in_tiles(spark, monkeypatch):
    """Blocks cut into tiles give the same groups."""
    df = spark.createDataFrame(prompts(150), PROMPTS)
    whole = rows(p3_versions.p3_found(df))
    monkeypatch.setattr(p3_versions, "TILE_ROWS", 16)
    assert rows(p3_versions.p3_found(df)) == whole


def test_sets_are_not_broadcast(spark, monkeypatch, tmp_path):
    """No join of word sequences, blocks or signatures sends a side to the driver, however small the optimizer takes it for."""
    spark.createDataFrame([(i, p) for i, p, _ in prompts(60) if i is not None and p is not None], "rep bigint, text string").dropDuplicates(["rep"]).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    sets, plans, cut = p3_versions.cut(p3_versions.sets_of(texts)), [], p3_versions.cut
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(p3_versions, "cut", lambda df: (seen(df), cut(df))[1])
    seen(p3_versions.version_links(sets))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_bit_sliced_distances():
    """Blocks of all sizes side by side give the pairs that plain distances give, and far words are abandoned."""
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 70, 60), [1, 2, 3, 64, 65, 200]])
    starts = np.cumsum(sizes) - sizes
    sigs = rng.integers(0, 2**63, (sizes.sum(), 8), dtype=np.uint64)
    for i in range(1, len(sigs), 3):
        sigs[i] = sigs[i - 1] ^ np.uint64(rng.integers(0, 2**30))
    limits = rng.integers(0, 130, len(sigs))
    near, led, leaders = set(), set(), starts + sizes // 2
    for s, k, top in zip(starts, sizes, leaders):
        block, most = sigs[s : s + k], limits[s : s + k]
        apart = np.bitwise_count(block[:, None] ^ block[None]).sum(2, dtype=int)
        near |= {(s + i, s + j) for i, j in zip(*np.nonzero(np.triu(apart <= np.minimum(most[:, None], most), 1)))}
        led |= {(top, s + i) for i in np.flatnonzero(apart[top - s] <= most) if s + i != top and k > 1}
    stats = {}
    assert set(zip(*close_pairs(sigs, limits, starts, sizes, stats))) == near and 0 < stats["abandoned"] < stats["words"]
    several = sizes > 1
    assert set(zip(*close_to_leader(sigs, limits, leaders[several], starts[several], sizes[several]))) == led
    assert len(close_pairs(sigs[:0], limits[:0], starts[:0], sizes[:0])[0]) == 0


# --- 2 and 5 -----------------------------------------------------------------------------------------------------------

WHOLE = ["A sentence.", "Is it?", "0.35", '{"a": [1]}', 'Here it is. {"a": "b"}', "```json\n{}\n```", "<PROMPT>\nx\n</PROMPT>", "It ended. (see above)", 'He said "yes."', "[1, 2]", "null.", '""']
CUT = ["A sentence that st", "fell to 0.", "and so...", "Das Ende…", '{"a": [1, ', '{"a": "b', "```json\n{}", '```json\n{"a": [\n```', "<PROMPT>\nx", "<PROMPT>\nx\n</PROM", 'Here it is. {"a": ', "He said \"no\" and", "word �", "[1, 2"]


def test_endings():
    assert [t for t in WHOLE if p2_cut.ending(t)[0] != "whole"] == []
    assert [t for t in CUT if p2_cut.ending(t)[0] == "whole"] == []
    assert p2_cut.ending(None)[0] == p2_cut.ending(" ​\n")[0] == "empty"


CALLS = "call_id bigint, provider string, model string, call_type string, input_prompt string, output string, success boolean, ingested_at timestamp"


def calls(outputs, prompt=lambda i: f"Question number {i} about the table?"):
    return [(i, "p", "M", "generate", prompt(i), o, None if i % 2 else True, None) for i, o in enumerate(outputs)]


def test_cut_calls(spark):
    closing = [f"Sentence {i} is whole.\n\nRegards\nthe desk" for i in range(8)]
    items = ["- alpha_one\n- beta_two\n- gamma_three"] * 2 + ["- beta_two\n- gamma_three\n- alpha_one", "- alpha_one\n- gamma_three\n- bet"]
    data = calls([*WHOLE, *closing, *items, *CUT, None, "", "Sentence 9 is whole.\n\nRegards\nthe d"])
    want = [(i,) for i, r in enumerate(data) if r[5] in CUT or r[5] in (items[3], "Sentence 9 is whole.\n\nRegards\nthe d")]
    df = frame(spark, CALLS, data + [(0, "p", "M", "generate", "", "later", True, None), (None, "p", "M", "x", "", "cut of", True, None)])
    got = rows(p2_cut.p2_found(df.where("not (call_id = 0 and output = 'later')")))
    assert got == sorted(want, key=repr)
    assert p2_cut.p2_rates(df).agg(F.sum("calls")).first()[0] == len(data)
    for f in (p2_cut.p2_found, p2_cut.p2_rates, p2_cut.p2_limits):
        assert rows(f(df.limit(0))) == []


def test_length_limits(spark):
    rng = random.Random(2)
    outputs = ["x" * rng.randint(300, 900) + "." for _ in range(300)] + ["y" * 640] * 30 + ["é" * 350] * 20
    got = {(r["measure"], r["length"]) for r in p2_cut.p2_limits(frame(spark, CALLS, calls(outputs))).collect()}
    assert {("chars", 640), ("bytes", 640), ("bytes", 700), ("chars", 350)} == got


def test_limits_of_short_fields(spark):
    """A limit of few characters is one, and many numbers or whole answers of one length are none."""
    rng = random.Random(3)
    outputs = [("w" * rng.randint(2, 7) + " ") * rng.randint(1, 7) + "end." for _ in range(300)] + [("word " * 20)[: 79 - i % 2] + "z" * (1 + i % 2) for i in range(30)]
    outputs += [f"0.{i:02}" for i in range(100)] + ["This answer is whole. " * 11 + "It is often given."] * 30
    got = {(r["measure"], r["length"]) for r in p2_cut.p2_limits(frame(spark, CALLS, calls(outputs))).collect()}
    assert got == {("chars", 80), ("bytes", 80)}
    rates = p2_cut.p2_rates(frame(spark, CALLS, calls(outputs))).first()
    assert rates["at_limit"] == 30


def test_pair_checks():
    assert all(p5_pairs.is_empty(t) for t in (None, "", " ​ ", "null", '""', "{}", "[ ]", "```json\n```", "<a></a>", "``` \n null\n```"))
    assert not any(p5_pairs.is_empty(t) for t in ("0", "nothing", '{"a": null}', "```\nx\n```"))
    q = 'Is "Ann Lee" the same as "Lee" in the field name? Answer with a number.'
    assert all(p5_pairs.is_copy(q, a) for a in (q, q.upper(), q.replace(" ", "  "), "Question: " + q, f"{q} {q}", q.replace("field", "field indeed")))
    assert not any(p5_pairs.is_copy(q, a) for a in ("0.5", q + " I think that they are different people, so the score is low.", 'You asked whether "Ann Lee" equals "Lee". They differ.', None))


def test_defects(spark):
    say = ["The value of the field was read from the table and the result is good.", "Le champ reste vide parce que la page n'a pas été lue dans la table.", "El campo quedó vacío porque la página no se leyó en la tabla."]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(say * 20, ["en", "FR-fr", "es"] * 20))], "doc_id bigint, text string, lang string")
    english = lambda i: f"The value of the field was read from the table {i} and the result is what?"
    refusals = [f"I cannot share the content of page {i + 3}." for i in range(4)] + ["I'd leave field_a to others, since it is private.", '{"error": "I must decline to read the file of Bob."}']
    data = calls([say[0], say[1], None, "The value of the field was read from", *refusals, english(10), 'Sorry for the delay. {"a": 1}'], english)
    data.append((50, "p", "M", "generate", "Please answer in French. The value of the field was read.", say[1], True, None))
    data.append((51, "p", "M", "generate", english(51), "", False, None))
    data.append((52, "p", "M", "generate", None, say[1], True, None))
    got = dict(rows(p5_pairs.p5_found(frame(spark, CALLS, data), clashing(docs))))
    assert got == {1: "language", 2: "empty", 3: "truncated", 4: "refusal", 5: "refusal", 6: "refusal", 7: "refusal", 9: "refusal", 10: "copy"}
    empty = spark.createDataFrame([], CALLS)
    assert rows(p5_pairs.p5_found(empty, docs)) == [] and rows(p5_pairs.p5_rates(empty, docs.limit(0))) == []


def test_refusals_without_a_known_phrase(spark):
    """A reply that comes back after unrelated prompts of several call types is a refusal in any wording; a usual answer that comes back isn't."""
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    say = lambda i: f"That request is outside of what this desk does for Firm{i} Works."
    data = [("extract", f"Read page {i} of the filing.", f'{{"total": {i}}}') for i in range(30)]
    data += [("generate", f"Why did rule {i} fail?", f"The total was read from the wrong line in run {i + 1}.") for i in range(30)]
    data += [("extract", f"Fill the record of annex {i}.", say(i)) for i in range(3)] + [("generate", f"Improve prompt {i}.", say(i)) for i in range(2)]
    frame_ = frame(spark, CALLS, [(i, "p", "M", k, p, o, True, None) for i, (k, p, o) in enumerate(data)])
    assert rows(p5_pairs.p5_found(frame_, docs)) == [(i, "refusal") for i in range(60, 65)]


def test_opening_links_without_the_leader(spark):
    """Openings of one band are linked to each other also where its smallest one is like none of them; tiles change nothing."""
    words = [f"w{i}" for i in range(12)]
    openings = {1: ["far", "off", "words"], 5: words[:10], 6: words[:9] + ["x"], 7: [f"v{i}" for i in range(9)], 8: [f"v{i}" for i in range(1, 10)]}
    nodes = spark.createDataFrame([(k, o, [77]) for k, o in openings.items()], "opening_key bigint, opening array<string>, bands array<bigint>")
    want = [(5, 6), (7, 8)]
    assert rows(p5_pairs.opening_links(nodes)) == want


def test_opening_links_in_tiles(spark, monkeypatch):
    rng = random.Random(8)
    openings = [[f"{k}w{i}" for i in range(10) if rng.random() < 0.9] + ["x"] for k in range(6) for _ in range(6)]
    nodes = spark.createDataFrame([(k, sorted(o), [7]) for k, o in enumerate(openings)], "opening_key bigint, opening array<string>, bands array<bigint>")
    near = [(a, b) for a, b in itertools.combinations(range(36), 2) if len(set(openings[a]) & set(openings[b])) >= 0.6 * len(set(openings[a]) | set(openings[b]))]

    def joined(links):
        root = list(range(36))
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    for tile in (1024, 5):
        monkeypatch.setattr(p5_pairs, "TILE_ROWS", tile)
        assert joined([tuple(r) for r in p5_pairs.opening_links(nodes).collect()]) == joined(near)


def test_one_pass_over_a_pair(monkeypatch):
    """the checks of a pair decode its JSON once, and MinHash values of many openings are counted together."""
    decoded, plain = [], json.JSONDecoder.raw_decode
    monkeypatch.setattr(json.JSONDecoder, "raw_decode", lambda self, s, at=0: decoded.append(s) or plain(self, s, at))
    answers = ['{"a": 1, "c": 2, "b": ["x y z w", "v"]}', '{"a": {"b": "I must decline to read it."}}', 'So: {"a": 2}']
    fresh = type(p2_cut.decoded)()
    for module in (p2_cut, p5_pairs):
        monkeypatch.setattr(module, "decoded", fresh)
    for a in answers:
        assert p2_cut.ending(a) == ("whole", "")
        assert p5_pairs.answer_text("judge", a) and (p5_pairs.refusal_text(a) is None) == ("decline" not in a)
    assert decoded == answers
    seeds = np.arange(1, 97, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    openings = [[f"w{i}" for i in range(k % 9)] for k in range(1200)]
    got = p5_pairs.min_hashes(openings, seeds)
    assert [bool(x) for x in got] == [len(o) >= 3 for o in openings] and all(len(x) in (0, p5_pairs.BANDS) for x in got)
    low = [min(((h := xxhash.xxh3_64_intdigest(w)) ^ h >> 29) * int(x) % 2**64 for w in openings[8]) for x in seeds]
    want = [xxhash.xxh3_64_intdigest(np.array(low[3 * b : 3 * b + 3], np.uint64).tobytes(), seed=b) - 2**63 for b in range(p5_pairs.BANDS)]
    assert got[8] == got[17] == got[1196] == want


def test_language_by_runs():
    """Words are told as single ones: the first with a capital, all in capitals, before an apostrophe; not beside hyphens, digits or marks."""
    from recordscope.llm.language import guess

    language = guess({w: {"en": -1.0, "fr": -5.0} for w in ("the", "of", "don", "and")} | {w: {"en": -5.0, "fr": -1.0} for w in ("le", "de", "été", "l")})
    assert language("The page of the record and the file") == "en" and language("Le nom DE la page, l'été, L’") is None
    assert language("LE nom de la page de l’an, le") == "fr" and language("don't THE of “and” x") == "en"
    assert language("of-the the_ the1 'and -of the of and") is None and language("x The the of and") is None and language("") is None
    assert guess({})("the of and the") is None


def test_words_of_ascii_and_others():
    for t in ("A_b c1-D, 2.5e3\tX", "don't A_B it's", "Straße été’s İx", "", "\x1c\x00a\x7fb"):
        assert p5_pairs.words(t) == p5_pairs.WORD.findall(t.casefold())
    for t in ("I cannot. ", "They said I CAN'T do it", "maſter, İ can", "unable", "Aujourd’hui je ne peux pas", "the off limits for me", "sí, no puedo"):
        assert bool(p5_pairs._STATED_ASCII.search(t.lower()) if t.isascii() else p5_pairs.STATED.search(t)) == bool(p5_pairs.STATED.search(t))
    assert p5_pairs.asked_language("Answer in the English language", lambda t: "fr") == "en" and p5_pairs.asked_language("Répondez en français", lambda t: "en") == "fr"
    assert p5_pairs.asked_language("Speak englisch", lambda t: "fr") == "fr" and p5_pairs.asked_language("auf Deutsch, bitte", lambda t: "fr") == "de"


def test_opening_links_over_batches(spark):
    """A group of openings that comes in several Arrow batches is one group."""
    openings = [[f"{k}w{i}" for i in range(10) if i != j] for k in range(3) for j in range(5)]
    openings.insert(0, ["far", "off", "words"])
    nodes = spark.createDataFrame([(k, sorted(o), [7]) for k, o in enumerate(openings)], "opening_key bigint, opening array<string>, bands array<bigint>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        links = rows(p5_pairs.opening_links(nodes))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(links) == {(a, b) for k in range(3) for a, b in itertools.combinations(range(1 + 5 * k, 6 + 5 * k), 2)}


# --- 4 -----------------------------------------------------------------------------------------------------------------

GOLD = "doc_no bigint, doc_id string, split string, source string, gold_data string"


def test_leaf_entries():
    a = p4_splits.leaf_entries('{"a": [{"b": " X "}, {"b": 1.0}], "c": [], "d": null, "e": {}, "f": true}')
    assert a == {("a[].b", "x"), ("a[].b", "1.0"), ("f", "true")}
    assert p4_splits.leaf_entries(json.dumps(json.dumps({"f": True}))) == {("f", "true")}
    for broken in (None, "", "{", "null", "5", '"x"', "[" * 99_999):
        assert p4_splits.leaf_entries(broken) == set()


def test_overlaps(spark):
    rng = random.Random(7)
    data = [(900, None, "train", None, None), (901, " - ", "val", "s", "{"), (902, "-", "train", "s", ""), (None, "x", "val", "s", "{}"), (903, "A b_c", "TEST ", "S", None), (904, "ab-C", "train", "s", "{}"), (905, "q", "other", "s", '{"k0": 0}')]
    base = [{f"k{j}": rng.randint(0, 9) for j in range(12)} for _ in range(8)]
    for i in range(150):
        r = dict(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            r[f"k{rng.randint(0, 11)}"] = rng.randint(0, 99)
        data.append((i, f"d{i % 140}", rng.choice(["train", "val", "test"]), "s", json.dumps(r)))
    want = set()
    key = lambda s: "".join(c for c in (s or "").lower() if c not in "-_ ")
    for a, b in itertools.permutations([r for r in data if r[0] is not None], 2):
        if a[2] == "train" and b[2].strip().lower() in ("val", "test"):
            x, y = p4_splits.leaf_entries(a[4]), p4_splits.leaf_entries(b[4])
            if key(a[1]) and key(a[1]) == key(b[1]) or x and y and 10 * len(x & y) >= 7 * len(x | y):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    df = frame(spark, GOLD, data + data[10:20])
    assert rows(p4_splits.p4_found(df)) == sorted(want, key=repr) and (903, 904) in want
    assert p4_splits.p4_report(df).agg(F.sum("pairs")).first()[0] == len(want)
    assert rows(p4_splits.p4_found(df.limit(0))) == rows(p4_splits.p4_report(df.limit(0))) == []


# --- 7, 8, 9 -----------------------------------------------------------------------------------------------------------


def test_myers():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ([rng.choice("abc") for _ in range(rng.randint(0, k))] for k in (70, 90))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert p7_leaks.myers(p, t)[0] == min(row)


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randint(0, 400))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 11, 12, 40, 70])))) for i in range(30)] + [(30, None), (None, "x"), (31, "")]
    docs = [(900, None), (None, "x"), (901, "")]
    for d in range(80):
        words = [word() for _ in range(60)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(items[:30])[1].split()
            at, n = rng.randrange(len(p)), rng.choice([6, 11, 12, 13, 40])
            words[rng.randrange(60) : 0] = p[at : at + n]
        docs.append((d, rng.choice([" ", ", ", " "]).join(words).replace("w1", rng.choice(["w1", "W​1"]))))
    form = visual_form()
    grams = lambda t: {tuple(w[i : i + 12]) for w in [p7_leaks.words_of(form, t or "")] for i in range(len(w) - 11)}
    held = [(i, grams(p)) for i, p in items if i is not None]
    want = sorted(((d, i) for d, t in docs if d is not None for g in [grams(t)] for i, p in held if g & p), key=repr)
    ddf, idf = frame(spark, "doc_id bigint, text string", docs), frame(spark, "item_id bigint, passage string", items)
    assert want and rows(p7_leaks.p7_found(ddf, idf)) == want
    assert rows(p7_leaks.leaks(ddf, idf, 0)) == rows(p7_leaks.leaks(ddf, idf))
    assert rows(p7_leaks.p7_found(ddf.limit(0), idf)) == rows(p7_leaks.p7_items(ddf, idf.limit(0))) == []


def test_pieces():
    """One piece more than the budget, all words covered, none longer than half a run."""
    for n in range(200):
        parts = p7_leaks.pieces(n)
        assert bool(parts) == (n >= p7_leaks.PIECE)
        assert [a for a, _ in parts] == [sum(s for _, s in parts[:i]) for i in range(len(parts))] and sum(s for _, s in parts) in (0, n)
        assert all(s <= p7_leaks.RUN // 2 for _, s in parts)


def test_edited_leaks(spark):
    """A passage with an edit in every six words has no run of 12, but is within its budget; one edit more in each piece is not. Both paths agree."""
    words = [f"w{i}" for i in range(60)]
    six = [w if i % 6 != 3 else "edit" for i, w in enumerate(words)]
    three = [w if i % 3 != 1 else "edit" for i, w in enumerate(words)]
    docs = frame(spark, "doc_id bigint, text string", [(1, " ".join(["far"] * 30 + six)), (2, " ".join(three)), (3, " ".join(["off"] * 9 + words[20:33] + ["on"])), (4, " ".join(words[20:31])), (4, " ".join(["a"] * 500 + words))])
    items = frame(spark, "item_id bigint, passage string", [(7, " ".join(words)), (7, "x y"), (8, "a b c d e")])
    for limit in (0, 10**6):
        got = {(r["doc_id"], r["item_id"]): (r["run"], r["part_edits"], r["edits"]) for r in p7_leaks.leaks(docs, items, limit).collect()}
        assert got == {(1, 7): (5, 2, 10), (3, 7): (13, 0, 47), (4, 7): (60, 0, 0)}
    assert rows(p7_leaks.p7_found(docs, items)) == [(3, 7), (4, 7)]
    assert rows(p7_leaks.p7_items(docs, items)) == [(7, 3, 2, 1, 1, 60, 0)]


def test_long_leaks_by_shuffle(spark):
    """A passage of many words is found whole by both paths."""
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(1, " ".join(["far"] * 300 + words + ["off"] * 300))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, passage string")
    assert rows(p7_leaks.leaks(docs, items, 0)) == rows(p7_leaks.leaks(docs, items)) == [(1, 7, 900, 0, 0, 179, 900)]


def test_mix(spark):
    docs = frame(spark, "doc_id bigint, text string, source string", [(i, f"text {i} " + "word " * 60, ["big", " BIG", "Small-one", "none"][0 if i % 2 else i % 4]) for i in range(400)] + [(900, None, "big"), (901, "x", None), (902, "", "big"), (903, "text 1 " + "word " * 60, "big")])
    targets = clashing(spark.createDataFrame([("BIG ", 0.5, 1), ("small_one", 0.25, 3), ("absent", 0.25, 4), ("zero", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int"))
    shares = {r["source"]: r for r in p8_mix.p8_shares(docs, targets).collect()}
    assert set(shares) == {"big", "small_one", "absent"} and shares["absent"]["used_tokens"] == 0
    assert shares["big"]["actual_share"] == pytest.approx(2 / 3, abs=0.02) and shares["small_one"]["weight"] == pytest.approx(1 / 3)
    used = p8_mix.p8_mix(docs, targets).collect()
    assert all(r["repeats"] <= {"big": 1, "small_one": 3}[r["source"]] for r in used) and not {900, 901, 902, 903} & {r["doc_id"] for r in used}
    chosen, _ = p8_mix.mix(docs, targets, total_tokens=10**6)
    most = chosen.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count"), F.min("count"))
    assert dict((r[0], (r[1], r[2])) for r in most.collect()) == {"big": (1, 1), "small_one": (3, 3)}
    assert rows(p8_mix.p8_mix(docs.limit(0), targets)) == rows(p8_mix.p8_shares(docs, targets.limit(0))) == []


ALIKE = [("раypal", "paypal"), ("Ｆｏｏｄ３", "Food3"), ("häuﬁg", "häufig"), ("сор", "cop"), ("a­b​⁠c", "abc"), ("ё", "ë"), ("x y z", "x y z"), ("Οк", "Oк")]
DIFFER = [("resume", "résumé"), ("a", "A"), ("1", "2"), ("a b", "a\nb"), ("a b", "a  b"), ("x²", "x2"), ("и", "u")]


@pytest.mark.parametrize("model", [None, pair_scores([("будь", 5), ("good", 50), ("запах", 5)])])
def test_visual_form(model):
    form = visual_form(model)
    for a, b in ALIKE:
        assert form(a) == form(b), (a, b)
    for a, b in DIFFER:
        assert form(a) != form(b), (a, b)
    for t in ("Нет, пустым осталось", "good ol' text", "Über"):
        assert form(t) == t and form(form(t)) == form(t)


def test_look_alikes(spark):
    data = [(1, "paypal"), (2, "раypal"), (3, "paypal"), (4, "PayPal"), (5, None), (6, ""), (7, "​"), (None, "paypal"), (8, "pаypal"), (8, "pаypal")]
    df = frame(spark, "doc_id bigint, text string", data)
    assert rows(p9_lookalikes.p9_found(df)) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (6, 7)]
    assert {r["form"] for r in p9_lookalikes.p9_forms(df).where("doc_id in (1, 2, 3, 8)").collect()} == {"paypal"}
    assert rows(p9_lookalikes.p9_found(df.limit(0))) == []


def test_script_model_of_all_words(spark):
    """The letter pairs are those of all distinct words, also of the 50,001st and of very long ones."""
    letters = "dfglmnrt"
    words = ["b" + "".join(letters[i >> k & 7] for k in (0, 3, 6, 9, 12)) + "z" * (i >> 15) for i in range(50_001)] + ["g" * 41, "я" * 3, "яz"]
    df = spark.createDataFrame([(i, " ".join(words[i::100] + ["bad"] * 2)) for i in range(100)], "doc_id bigint, text string")
    model = p9_lookalikes.script_model(df)
    assert len(set(words)) == len(words) and model == pytest.approx(pair_scores([*((w, 1) for w in words), ("bad", 200)]))
    assert (0, "g", "g") in model and (1, "я", "я") in model and (1, "я", "z") not in model


@pytest.mark.parametrize("size", ["sf0.001"])
def test_given_tables(spark, data, size):
    """Every query runs on the given tables and gives rows."""
    from recordscope.llm import registry

    for name, f in registry.QUERIES.items():
        assert f(spark, data).columns, name
    assert table(spark, data, "documents").count() > 0


def test_evidence(spark):
    """Each cut value and each refusal says what told it: limits, structure and lines; templates without and with a known phrase, and a phrase alone."""
    rng = random.Random(6)
    text = lambda n: ("".join(rng.choice("abcde ") for _ in range(n)))[: n - 1] + "z"
    outputs = [f"{text(rng.randint(100, 400))}." for _ in range(200)] + [text(300) for _ in range(20)] + ['{"a": [1, ', "An end with no point here", "last words of any kind", "I am un"]
    found = p2_cut.classified(frame(spark, CALLS, calls(outputs))).where("evidence is not null")
    assert rows(found.groupBy("evidence").count()) == [("limit", 20), ("line", 3), ("structure", 1)]
    say = lambda i: f"That request is outside of what this desk does for Firm{i} Works."
    known = lambda i: f"I cannot share the content of page {i + 3}."
    data = [("extract", f"Read page {i} of the filing.", f'{{"total": {i}}}') for i in range(30)]
    data += [("generate", f"Why did rule {i} fail?", f"The total was read from the wrong line in run {i + 1}.") for i in range(30)]
    data += [("extract", f"Fill the record of annex {i}.", f(i)) for i in range(3) for f in (say, known)] + [("generate", f"Improve prompt {i}.", f(i)) for i in range(2) for f in (say, known)]
    data.append(("generate", "Write a better rule.", "My rules do not allow it, dear reader of mine."))
    frame_ = frame(spark, CALLS, [(i, "p", "M", k, p, o, True, None) for i, (k, p, o) in enumerate(data)])
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert rows(p5_pairs.p5_rates(frame_, docs).where("defect = 'refusal'")) == [("refusal", "phrase", 1), ("refusal", "template and phrase", 5), ("refusal", "template", 5)]
