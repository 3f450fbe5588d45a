"""Source divergence, merge automaton and fill-in-middle against brute force and the tokenizer library."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pacelake.llm import divergence, fill_middle, merge_automaton

SCHEMA = "doc_id long, text string, lang string, source string, kept long, uses string, ids string, form string, word int"
WORDS = "ka lo mi ne Ößt ru su ta vo 東京 it's don't A1b x,y".split()
PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(n=300, seed=3):
    draw = random.Random(seed)
    out = [(i, " ".join(draw.choice(WORDS[: 3 + i % 12]) for _ in range(draw.randrange(60))), draw.choice(["en", "de", None]),
            "hot" if i % 3 else draw.choice(["a", "b", None]), i, "u", "i", "f", 1) for i in range(n)]
    out += [(None, None, None, None, None, None, None, None, None), (7, "", "xx", "lone", 1, "u", "i", "f", 1)]
    out += [(8, "solo solo solo", "xx", "other", 1, "u", "i", "f", 1)] * 2 + [(9, "Éa " * 40_000, "en", "long", 1, "u", "i", "f", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def divergence_by_hand(given, min_docs=3, top=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(fold))) for r in given]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(term for d in mine for term in set(d[2]))
        kept = sorted(term for term, n in held.items() if n >= min_docs)
        uses = {s: Counter(t for d in mine if d[1] == s for t in d[2] if held[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(uses.values(), Counter())

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in uses.items()}
        q = shares(whole)
        for s in uses:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in uses if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if uses[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[: top if part == "term" else None])]
    return sorted(out)


def test_divergence_by_hand(spark, docs):
    got = sorted(tuple(r) for r in divergence.source_divergence(docs.repartition(5)).collect())
    assert got == divergence_by_hand(rows())


def test_divergence_cuts_terms_and_flushes(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 50)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, min_docs=2, top=3).collect())
    assert got == divergence_by_hand(rows(), 2, 3)


def test_divergence_of_nothing(spark, docs):
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_joint_cells_are_population_counts():
    bits = np.array([-1, 5, 1 << 62], dtype=np.int64).view(np.uint64)
    into: dict = {}
    p = np.array([40, 30, 20])
    divergence._joint(bits, p, np.array([2, 2, 2]), np.array([0, 1, 1]), into, ["a", "b"])
    f = lambda x, y: (x - y) ** 2 // y
    each = lambda a, b: f(a, b) - f(2, b) - f(a, 2) + f(2, 2)
    assert into == {("a", "b"): 2 * each(40, 30) + each(40, 20), ("b", "a"): 2 * each(30, 40) + each(20, 40)}


@pytest.fixture(scope="module")
def coder():
    return merge_automaton.coder(PATH)


def ids_of(coder, texts):
    return [np.frombuffer(packed, dtype="<i4").tolist() for packed in coder.encode(texts)]


def test_automaton_encodes_as_the_library(coder):
    library = Tokenizer.from_file(PATH)
    draw = random.Random(5)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "aaab", "тест", "中文字", "!?.,-'\" ", "0123 \t\n", "ÀİΣς", "é​ \x00\x1c\x85"]
    texts = ["".join(draw.choice("".join(draw.sample(letters, 2))) for _ in range(draw.choice([0, 3, 9, 40]))) for _ in range(3000)]
    texts += ["a<|endoftext|>B <|startoftext|>", "we'LL it's", "a" * 3000, "".join(draw.choice("abcdef") for _ in range(5000)), "中文" * 900]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(coder, texts) == want
    assert [coder.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_automaton_accepts_only_right_tokenizations():
    # a=0 b=1, merges: ab, aa, then ab+aa, checked against all strings' own merging.
    merges = [(0, 1, 2), (0, 0, 3), (2, 3, 4), (3, 3, 5)]
    automaton = merge_automaton.Automaton([0, 1], merges)
    spelt = {0: "a", 1: "b", 2: "ab", 3: "aa", 4: "abaa", 5: "aaaa"}

    def merged(text):
        tokens = [0 if c == "a" else 1 for c in text]
        for left, right, result in merges:
            out, i = [], 0
            while i < len(tokens):
                if tokens[i : i + 2] == [left, right]:
                    out.append(result)
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def accepted(text, state=0):
        if not text:
            yield []
        for token, label in spelt.items():
            if text.startswith(label):
                to = automaton.step(state, token)
                assert automaton.steps(np.array([state]), np.array([token])).tolist() == [to]
                if to >= 0:
                    yield from ([token, *rest] for rest in accepted(text[len(label):], to))

    for n in range(11):
        for k in range(2**n):
            text = "".join("ab"[k >> i & 1] for i in range(n))
            assert list(accepted(text)) == [merged(text)], text


def test_automaton_refuses_improper_merges():
    with pytest.raises(ValueError, match="merge 0"):
        merge_automaton.Automaton([0, 1], [(0, 2, 3)])


def test_automaton_forgets_without_changing_results(monkeypatch):
    monkeypatch.setattr(merge_automaton, "KNOWN", 5)
    monkeypatch.setattr(merge_automaton, "BATCH_CHARS", 7)
    fresh = merge_automaton.Coder(PATH)
    texts = [r[1] or "" for r in rows(60)]
    assert ids_of(fresh, texts[:30]) + ids_of(fresh, texts[30:]) == ids_of(merge_automaton.coder(PATH), texts)


def test_automaton_over_a_table(spark, docs):
    library = Tokenizer.from_file(PATH)
    found = merge_automaton.decode(merge_automaton.encode(docs, "text", PATH), PATH).collect()
    want = Counter()
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], r[2], r[4], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.lang, r.kept, tuple(r.ids), r.decoded) for r in found) == want
    assert merge_automaton.encode(docs.limit(0), "text", PATH).count() == 0


def test_skip_list_reaches_every_rank():
    draw = random.Random(1)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        widths = np.array([draw.randrange(1, 6) for _ in range(n)], dtype=np.int64)
        chain = fill_middle.SkipList(widths)
        offsets = np.concatenate(([0], np.cumsum(widths))).tolist()
        ranks = range(n + 1) if n < 400 else draw.sample(range(n + 1), 200)
        assert [chain.offset(r) for r in ranks] == [offsets[r] for r in ranks]


def test_units_cover_the_text():
    pattern = re.compile(r"\w+")
    assert fill_middle.unit_points("..ab, c! ", pattern).tolist() == [4, 5]
    assert fill_middle.unit_points("..", pattern).tolist() == [2]
    assert fill_middle.unit_points("", pattern).tolist() == []


@pytest.mark.parametrize("unit", [None, r"\w+", r"(?s)."])
def test_fill_in_middle_by_hand(spark, docs, unit):
    extra = [(10**6 + i, t, "en", "s", 1, "u", "i", "f", 1) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<<<S", "<", "<M", "P><P"] * 30)]
    given = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    found = fill_middle.restore(fill_middle.fill_in_middle(given, unit=unit)).collect()
    want = Counter()
    for r in rows() + extra:
        text = r[1] or ""
        digest = hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        ends = np.cumsum([0, *fill_middle.unit_points(text, re.compile(unit) if unit else None).tolist()]).tolist()
        n = len(ends) - 1
        a, b = sorted(ends[x % (n + 1)] for x in h[:2])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {
            "plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}",
        }[form]
        plain = form == "plain"
        want[r[0], r[4], r[5], n, form, None if plain else a, None if plain else b - a, output, text] += 1
    assert Counter(
        (r.doc_id, r.kept, r.uses, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found
    ) == want
    assert len({r.form for r in found}) == 3


def test_fill_in_middle_of_nothing(spark, docs):
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0))).count() == 0
    assert fill_middle.fill_in_middle(docs.select(F.col("doc_id"), F.col("text"))).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"
    ]
