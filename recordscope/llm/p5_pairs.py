"""Problem 5: prompt and response pairs whose response is no answer.

Refusals are found by their templates: the opening of each response, with names, codes, numbers and quotes
replaced by marks, is given MinHash values; openings that share a band and whose word sets are verified to be similar
form clusters. A cluster whose openings come back after unrelated prompts is a template, and it
is one of refusal if most of its openings state that the writer can't or won't answer, or, whatever its wording, if it
answers calls of several types alike, says little of what the prompts say and often lacks the form that answers of the
call type have. Empty, copied, cut and
wrong-language answers are told by checks of each pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordscope.llm.language import guess, word_model
from recordscope.llm.p2_cut import INVISIBLE, JSON_START, _balanced_end, decided, decoded, ending, inner_items, source_name, trim
from recordscope.operators.components import components
from recordscope.session import cut

#: MinHash bands and rows of a band; similarity of verified openings; words of an opening that count.
BANDS, ROWS, SIMILAR = 16, 3, 0.6
OPENING_WORDS = 24
#: A band that more openings than this share is compared in tiles of about so many openings.
TILE_ROWS = 1024
#: Prompts that must share a template, and the share of its openings that state a refusal.
TEMPLATE_PROMPTS, REFUSAL_SHARE = 3, 0.5
#: A form of at least USUAL of the answers of a call type is its usual one. A template is one of refusal without any phrase if
#: it answers several call types, at least OFF_FORM of its answers lack the usual form, and at most ECHO of their words are the prompt's.
USUAL, OFF_FORM, ECHO = 0.8, 0.2, 0.25
#: Words that a copy may add: lead-ins and single inserted words. The log keeps so many characters of a prompt.
COPY_EXTRA, LOGGED = 6, 500
#: Openings whose MinHash values are counted together.
HASHED_ROWS = 512
#: Words whose marks a task keeps.
KEPT = 50_000

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
NOTHING = re.compile(rf"```[\w+-]*|<[^<>]*>|\bnull\b|[\s{INVISIBLE}\"'“”„«»‘’`{{}}\[\](),:;]+", re.I)

SCORE = re.compile(r"\W*\d")
#: Five letters that NOTHING never takes where there is no tag.
_LETTERS = re.compile(r"(?<![\w+`-])[A-Za-z]{5}")
#: WORD for ASCII without apostrophes: letters in lower case and digits stay, all else is blank.
_ASCII_WORDS = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}

_FENCE, _TAGS, _PART = re.compile(r"```[\w+-]*"), re.compile(r"<[^<>]*>"), re.compile(r"[^\s.!?]+|[.!?]+")
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”')
_OUTER = re.compile(r"^\W+|\W+$")

#: Phrases by which a writer states not to be able or willing to answer, in four languages.
STATED = re.compile(
    r"\b(?:i (?:cannot|can not|can['’]?t|won['’]?t|will not|am unable|am not able|must (?:decline|refuse)|have to (?:decline|refuse|leave)|decline to|refuse to|do not feel comfortable|don['’]?t feel comfortable|would rather not|am not comfortable|am not allowed|am not permitted)\b"
    r"|i['’]d rather not\b|i['’]m (?:unable|not able|not allowed|not permitted|not comfortable)\b|not possible for me\b|off limits for me\b|my (?:rules|guidelines|instructions|policy|policies) (?:do|does) ?n[o'’]t (?:allow|permit)|my rules do not allow\b"
    r"|against my (?:guidelines|instructions|rules|policy|principles)\b|under my usage policy\b|i have to leave to a human\b"
    r"|je ne (?:peux|puis|suis) pas\b|m['’]est impossible\b|je (?:refuse|dois refuser)\b"
    r"|no puedo\b|no me es posible\b|no estoy autorizad[oa]\b|debo rechazar\b"
    r"|(?:kann|darf|möchte) ich\b[^.!?\n]{0,60}\bnicht\b|ich (?:kann|darf|möchte)\b[^.!?\n]{0,60}\bnicht\b|muss ich ablehnen\b)",
    re.I,
)

_STATED_ASCII = re.compile(STATED.pattern)

#: Names of the languages in each of them.
LANGUAGES = {
    "en": "english|anglais|inglés|ingles|englisch|englische|englischer",
    "fr": "french|français|francais|francés|frances|französisch|französische",
    "es": "spanish|espagnol|español|espanol|spanisch|spanische",
    "de": "german|allemand|alemán|aleman|deutsch|deutsche",
    "ru": "russian|russe|ruso|russisch|russische",
}
ASKED = {g: re.compile(rf"\b(?:in|into|en|al|auf|ins|to)\s+(?:\w+\s+)?(?:{names})\b", re.I) for g, names in [*LANGUAGES.items(), ("", "|".join(LANGUAGES.values()))]}
ASKED_ANY = ASKED.pop("")
_ASCII_NAMES = [n for names in LANGUAGES.values() for n in names.split("|") if n.isascii()]
_ASCII_NAMES = [n for n in _ASCII_NAMES if not any(x in n and x != n for x in _ASCII_NAMES)]


def is_empty(text: str | None) -> bool:
    if not text:
        return True
    head = text[:200]
    if "<" not in head and _LETTERS.search(head):
        return False
    # five characters left of the beginning, short of a tag it may have split, show that there is something
    if len(NOTHING.sub("", head.rpartition("<")[0] if "<" in head else head)) >= 5:
        return False
    return not NOTHING.sub("", text)


def words(text: str) -> list[str]:
    if text.isascii() and "'" not in text:
        return text.translate(_ASCII_WORDS).split()
    return WORD.findall(text.casefold())


def is_copy(prompt: str | None, answer: str | None) -> bool:
    """Whether the answer is the prompt again, once or twice, with little added. A prompt that the log cut may go on in the answer."""
    return bool(prompt and answer) and copied(words(prompt), words(answer), len(prompt) >= LOGGED)


def copied(p: list[str], a: list[str], logged: bool) -> bool:
    """is_copy() of the words of both; ``logged`` prompts have the greatest length that the log keeps."""
    if len(p) < 3:
        return p == a and bool(p)
    for times in (1, 2):
        size = len(p) * times
        extra, most = max(COPY_EXTRA, size // 10), size // 10
        if not 0.9 * size <= len(a) <= size + extra and not (times == 1 and logged and len(a) > len(p)):
            continue
        # words of the prompt found in order
        i = missed = 0
        for w in p * times:
            try:
                i = a.index(w, i, i + extra + 1) + 1
            except ValueError:
                missed += 1
                if missed > most:
                    break
        if missed <= most:
            return True
    return False


def _json_strings(text: str, most: int | None = None) -> tuple[list[str], int] | None:
    """Text values of the JSON in ``text`` and how many other values it has; None if there is none. Beyond ``most`` of either the rest is left."""
    m = JSON_START.search(text)
    if not m or (found := decoded(text, m.start())) is None:
        return None
    strings, others, todo = [], 0, [found[0]]
    while todo and (most is None or len(strings) <= most and others <= most):
        x = todo.pop()
        if isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, str) and x.strip():
            strings.append(x)
        elif x is not None and x is not False and x != "":
            others += 1
    return strings, others


def refusal_text(answer: str) -> str | None:
    """The part of an answer that may be a refusal: its text, or the only text inside JSON; None if there is an answer beside it."""
    s = trim(_FENCE.sub("", answer) if "```" in answer else answer)
    found = _json_strings(s, 3)
    if found is not None:
        strings, others = found
        long = [x for x in strings if len(x.split()) >= 4]
        return long[0] if others <= 1 and len(long) == 1 and len(strings) <= 3 else None
    return trim(_TAGS.sub("", s) if "<" in s else s) or None


class _Marks(dict):
    """Part of a text -> its word or mark at the start of a sentence and elsewhere, '' for nothing; None ends a sentence. The first KEPT are kept."""

    def __reduce__(self):  # tasks begin with an empty one
        return _Marks, ()

    def __missing__(self, w: str) -> tuple[str, str] | None:
        if w[0] in ".!?":
            return None
        bare = w if w[0].isalnum() and w[-1].isalnum() else _OUTER.sub("", w)
        if "_" in bare:
            marks = "<f>", "<f>"
        elif any(map(str.isdigit, bare)):
            marks = "<n>", "<n>"
        else:
            name = bare[:1].isupper() and not bare.isupper() and bare != "I" and not bare.startswith("I'")
            marks = bare.casefold(), "<w>" if name else bare.casefold()
        if len(self) < KEPT:
            self[w] = marks
        return marks


_MARKS = _Marks()


def masked(text: str) -> list[str]:
    """Words of the opening, with quotes, codes, numbers and names (capitals inside a sentence) as marks."""
    text = " ".join(text.split(None, 4 * OPENING_WORDS)[: 4 * OPENING_WORDS])
    text = _QUOTED.sub(" Q ", text)
    out = []
    start = True
    for m in _PART.finditer(text):
        marks = _MARKS[m[0]]
        if marks is None:
            start = True
        elif marks[0]:
            out.append(marks[not start])
            start = False
            if len(out) == OPENING_WORDS:
                break
    return out


def answer_text(call_type: str | None, answer: str) -> str:
    """The text of an answer in the writer's own words; the values of an extraction are not."""
    s = _FENCE.sub("", answer) if "```" in answer else answer
    m = JSON_START.search(s)
    if m and (end := _balanced_end(s, m.start())) > 0:
        if (call_type or "").strip().lower() == "extract":
            return ""
        found = _json_strings(s)
        inside = " ".join(x for x in found[0] if len(x.split()) >= 4) if found else ""
        return f"{s[: m.start()]} {inside} {s[end:]}"
    return _TAGS.sub(" ", s) if "<" in s else s


def answer_form(answer: str) -> str:
    """Whether an answer has a JSON value, begins with a number or is text."""
    return "record" if JSON_START.search(answer) else "score" if SCORE.match(answer) else "text"


def echo(prompt: list[str], answer: list[str]) -> float:
    """The share of the answer's longer words that the prompt has too."""
    said = {w for w in answer if len(w) > 3}
    return len(said.intersection(prompt)) / max(1, len(said))


def asked_language(prompt: str, language) -> str | None:
    low = prompt.lower()
    if (not prompt.isascii() or any(n in low for n in _ASCII_NAMES)) and ASKED_ANY.search(prompt):
        return next(g for g, pattern in ASKED.items() if pattern.search(prompt))
    return language(prompt)


def min_hashes(openings: list[list[str]], seeds: np.ndarray) -> list[list[int]]:
    """The MinHash bands of each list of different words; none of lists of fewer than three."""
    bands: list[list[int]] = [[] for _ in openings]
    told = [i for i, tokens in enumerate(openings) if len(tokens) >= 3]
    for lo in range(0, len(told), HASHED_ROWS):
        part = told[lo : lo + HASHED_ROWS]
        h = np.array([xxhash.xxh3_64_intdigest(t) for i in part for t in openings[i]], np.uint64)
        starts = np.cumsum([0, *(len(openings[i]) for i in part[:-1])])
        with np.errstate(over="ignore"):
            low = np.minimum.reduceat((h ^ (h >> np.uint64(29)))[None, :] * seeds[:, None], starts, axis=1)
        raw, width = np.ascontiguousarray(low.T).tobytes(), 8 * ROWS
        for k, i in enumerate(part):
            bands[i] = [xxhash.xxh3_64_intdigest(raw[at : at + width], seed=b) - 2**63 for b, at in enumerate(range(k * width * BANDS, (k + 1) * width * BANDS, width))]
    return bands


def features(calls: DataFrame, model: dict) -> DataFrame:
    """What the checks say of each row, and the MinHash bands of the opening. Language counts only where no other check decides, echo where there are bands."""
    shared = calls.sparkSession.sparkContext.broadcast(model)
    seeds = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = guess(shared.value)
        for batch in batches:
            found: list[tuple] = []
            for kind, prompt, answer in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 3, batch.num_columns))):
                asked, given = words(prompt or ""), words(answer or "")
                empty, copy = is_empty(answer), bool(prompt and answer) and copied(asked, given, len(prompt) >= LOGGED)
                state, unit = ending(answer)
                opening, stated, wrong, form, said = [], False, False, None, None
                if not empty:
                    form = answer_form(answer)
                    text = refusal_text(answer)
                    if text:
                        opening = sorted(set(masked(text)))
                        head = " ".join(text.split(None, 2 * OPENING_WORDS)[: 2 * OPENING_WORDS])
                        stated = bool(_STATED_ASCII.search(head.lower()) if head.isascii() else STATED.search(head))
                    if len(opening) >= 3:
                        said = echo(asked, given)
                    own = answer_text(kind, answer) if prompt and not (copy or stated or state == "cut") else ""
                    if len(own) > 12 and (got := language(own)):
                        want = asked_language(prompt, language)
                        wrong = want is not None and got != want
                prompt_key = xxhash.xxh3_64_intdigest(" ".join(asked)) - 2**63
                found.append((empty, copy, wrong, stated, opening, (kind or "").strip().lower(), form, said, prompt_key, state, unit, inner_items(answer)))
            cols = list(zip(*found)) if found else [()] * 12
            cols.insert(5, min_hashes(cols[4], seeds))
            types = [pa.bool_()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            names = ["empty", "copy", "wrong", "stated", "opening", "bands", "kind", "form", "echo", "prompt_key", "state", "unit", "items"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *(pa.array(c, t) for c, t in zip(cols, types))], [*batch.schema.names[:-3], *names])

    source = calls.select(F.col("call_id").cast("bigint"), F.col("success").cast("boolean").alias("success"), F.col("ingested_at").alias("_latest"), F.length("output").alias("chars"), F.octet_length("output").alias("bytes"), source_name("provider").alias("provider"), source_name("model").alias("model"), F.col("call_type").cast("string").alias("_k"), F.col("input_prompt").cast("string").alias("_p"), F.col("output").cast("string").alias("_o"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-3])
    rows = source.where("call_id is not null").mapInArrow(run, f"{fields}, empty boolean, copy boolean, wrong boolean, stated boolean, opening array<string>, bands array<bigint>, kind string, form string, echo double, prompt_key bigint, state string, unit string, items array<string>")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc_nulls_last("_latest"), F.desc("chars"), "opening"))).where("_n = 1").drop("_n", "_latest")


def opening_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all openings which share a band and whose word sets are verified to be similar.

    The first round compares each opening with the smallest one of each of its bands; the second compares, in tiles
    of large bands, all that are not joined yet, and keeps one link of two components a tile.
    """
    banded = nodes.select("opening_key", F.posexplode("bands").alias("band", "value"))
    leaders = banded.groupBy("band", "value").agg(F.min("opening_key").alias("leader"))
    pairs = banded.join(leaders, ["band", "value"]).where("leader <> opening_key").select(F.col("leader").alias("a"), F.col("opening_key").alias("b")).distinct()
    sides = nodes.select("opening_key", "opening")
    both = pairs.join(sides.toDF("a", "oa"), "a").join(sides.toDF("b", "ob"), "b")
    shared = F.size(F.array_intersect("oa", "ob"))  # an opening has each word once
    stars = cut(both.withColumn("shared", shared).where(F.col("shared") >= SIMILAR * (F.size("oa") + F.size("ob") - F.col("shared"))).select("a", "b"))
    known = components(stars).select(F.col("node").alias("opening_key"), "root")
    labelled = nodes.select("opening_key", "bands", F.transform("opening", lambda w: F.xxhash64(w)).alias("words")).join(known, "opening_key", "left").withColumn("comp", F.coalesce("root", "opening_key")).drop("root")
    mixed = labelled.select("opening_key", "comp", F.posexplode("bands").alias("band", "value"))
    open_bands = mixed.groupBy("band", "value").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("*").alias("members")).where("_low <> _high").select("band", "value", "members")
    chunks = F.ceil(F.col("members") / F.lit(TILE_ROWS)).cast("int")
    tiled = mixed.join(open_bands, ["band", "value"]).withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("opening_key"), F.col("chunks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("tile", F.least("side", "other") * F.col("chunks") + F.greatest("side", "other"))
    posted = tiled.select("band", "value", "tile", "opening_key", "comp").join(labelled.select("opening_key", "words"), "opening_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, found = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "value", "tile")], axis=1)
            node, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opening_key", "comp"))
            at, flat = batch.column("words").offsets.to_numpy(), batch.column("words").values.to_numpy(zero_copy_only=False)
            size = np.diff(at)
            bounds = [*np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(bounds, bounds[1:]):
                if (key := tuple(keys[lo].tolist())) != group:
                    found += _between(held)
                    group, held = key, []
                held.append((node[lo:hi], comp[lo:hi], size[lo:hi], flat[at[lo] : at[hi]]))
            yield links(found)
            found = []
        yield links(_between(held))

    def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stars.unionByName(posted.repartition("band", "value", "tile").sortWithinPartitions("band", "value", "tile").mapInArrow(run, "a bigint, b bigint").distinct())


def _between(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """One pair of similar openings for each two components that have one; of parts (nodes, components, numbers of words, words)."""
    if not held:
        return []
    node, comp, count, words = (np.concatenate(x) for x in zip(*held))
    if (comp == comp[0]).all():
        return []
    known, col = np.unique(words, return_inverse=True)
    has = np.zeros((len(node), len(known)), np.float32)
    has[np.repeat(np.arange(len(node)), count), col] = 1
    size, found = has.sum(axis=1), {}
    for lo in range(0, len(node), 512):
        both = has[lo : lo + 512] @ has.T
        near = (both >= SIMILAR * (size[lo : lo + 512, None] + size[None, :] - both).astype(np.float64)) & (comp[lo : lo + 512, None] < comp[None, :])
        for i, j in zip(*np.nonzero(near)):
            found[int(comp[lo + i]), int(comp[j])] = int(node[lo + i]), int(node[j])
    return list(found.values())


def refusal_templates(rows: DataFrame) -> DataFrame:
    """(opening_key, prompts, stated_share) of the openings of templates of refusal. Equal openings are one node.

    Prompts are counted exactly over each cluster, those with the same words once. Copies of the prompt are no evidence of a refusal.
    """
    keyed = rows.where(F.size("bands") > 0).withColumn("opening_key", F.xxhash64("opening"))
    nodes = cut(keyed.groupBy("opening_key").agg(F.first("opening").alias("opening"), F.first("bands").alias("bands")))
    roots = components(opening_links(nodes))
    clusters = nodes.select("opening_key").join(roots.select(F.col("node").alias("opening_key"), "root"), "opening_key", "left").withColumn("root", F.coalesce("root", "opening_key"))
    forms = rows.where("form is not null").groupBy("kind", "form").agg(F.count("*").alias("n"))
    usual = forms.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind"))).where(F.col("share") >= USUAL).select("kind", F.col("form").alias("usual"))
    members = keyed.select("opening_key", "prompt_key", "stated", "copy", "kind", "form", "echo").join(usual, "kind", "left").join(clusters, "opening_key")
    own = lambda c: F.when(~F.col("copy"), c)
    share = lambda c: F.coalesce(F.avg(own(c)), F.lit(0.0))
    by_root = members.groupBy("root").agg(
        F.countDistinct("prompt_key").alias("prompts"), F.avg(F.col("stated").cast("int")).alias("stated_share"),
        F.countDistinct(own(F.col("prompt_key"))).alias("own_prompts"), F.countDistinct(own(F.col("kind"))).alias("kinds"),
        share(F.coalesce(F.col("form") != F.col("usual"), F.lit(False)).cast("int")).alias("off_form"), F.avg(own(F.col("echo"))).alias("echo"),
    )
    stated = (F.col("prompts") >= TEMPLATE_PROMPTS) & (F.col("stated_share") >= REFUSAL_SHARE)
    unlike = (F.col("own_prompts") >= TEMPLATE_PROMPTS) & (F.col("kinds") > 1) & (F.col("off_form") >= OFF_FORM) & (F.col("echo") <= ECHO)
    return clusters.join(by_root.where(stated | unlike), "root").select("opening_key", "prompts", "stated_share")


def defects(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """(call_id, success, defect, evidence) of every call, each once; defect is null for an answer.

    The first of empty, truncated, refusal, copy and language that applies counts. evidence says how a cut answer (limit, structure,
    line) or a refusal (template, phrase, or both) was told. Of rows with one call_id the one ingested last counts. Null
    prompts can be neither copied nor asked in a language. Rows with a null call_id are left out; empty tables give
    no rows; extra columns play no part.
    """
    rows = cut(features(calls, word_model(documents)))
    templates = refusal_templates(rows).select("opening_key", F.lit(True).alias("template"))
    ended = decided(rows.select("call_id", "chars", "bytes", "provider", "model", "state", "unit", "items"), ["provider", "model"])
    broken = ended.where("evidence is not null").select("call_id", F.col("evidence").alias("broken"))
    told = rows.withColumn("opening_key", F.xxhash64("opening")).join(templates, "opening_key", "left").join(broken, "call_id", "left")
    template = F.coalesce("template", F.lit(False))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("broken").isNotNull(), "truncated")
        .when(F.col("stated") | template, "refusal")
        .when(F.col("copy"), "copy")
        .when(F.col("wrong"), "language")
    )
    evidence = F.when(F.col("defect") == "truncated", F.col("broken")).when(F.col("defect") == "refusal", F.when(template & F.col("stated"), "template and phrase").when(template, "template").otherwise("phrase"))
    return told.withColumn("defect", defect).select("call_id", "success", "defect", evidence.alias("evidence"))


def p5_found(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """(call_id, defect) of the calls with success true or null whose response is no answer."""
    return defects(calls, documents).where("coalesce(success, true) and defect is not null").select("call_id", "defect")


def p5_rates(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """(defect, evidence, calls): how many calls with success true or null have each defect, by the evidence; sound answers are 'none'."""
    return defects(calls, documents).where("coalesce(success, true)").groupBy(F.coalesce("defect", F.lit("none")).alias("defect"), F.coalesce("evidence", F.lit("")).alias("evidence")).agg(F.count("*").alias("calls"))
