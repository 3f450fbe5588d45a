"""The llm operators against brute force, SQL, round trips and held-out labels."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import difference, duck
from pacelake.llm import byte_bpe, chat, neighbours, packing, pieces, pii, quality_model, quality_rules, simhash, substring_dedup, warc
from pacelake.session import ship_package

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing names."""
    rows = [
        (None, None, None, None, None), (1, "", "en", None, 0), (2, " \n\t ", None, "s", 3), (3, "one two", "en", "s", 7),
        (3, "one two", "en", "s", 7), (4, "word " * 5000, "en", "s", 25000), (None, "word " * 40, "en", "s", 200),
        (5, "é漢😀 a@b.co \x00", "fr", "t", 9),
    ]
    extra = [F.lit(n).alias(c) for n, c in enumerate(("ids", "score", "length", "base", "fingerprint", "n_words", "piece", "_x"))]
    return spark.createDataFrame(rows, SCHEMA).select("*", *extra).coalesce(2)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_matches_sql(spark, name):
    assert difference(entry.LLM_QUERIES[name](spark, SF), duck(SF), entry.LLM_ORACLES[name]) is None


@pytest.mark.parametrize("empty", [True, False])
def test_odd_and_empty_tables(spark, odd, empty):
    docs = odd.limit(0) if empty else odd
    n = 0 if empty else odd.count()
    labels = spark.createDataFrame([(None, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality_rules.quality_rules(docs).collect()) == n
    assert len(byte_bpe.decode(byte_bpe.encode(docs, "text", RANKS), RANKS).collect()) == n
    assert len(simhash.simhash_dedup(docs).collect()) == n
    assert len(quality_model.score(docs, quality_model.fit(docs, labels)).collect()) == n
    assert len(substring_dedup.substring_dedup(docs, bits=1 << 12).collect()) == n
    assert len(pii.find_spans(docs).collect()) == n
    cut = packing.token_pieces(docs, "text", VOCABULARY, 2, 64).drop("ids")
    assert len(packing.pack_best_fit(cut, 64).filter("start = 0").collect()) == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "_x")
    assert len(warc.read_archives(spark, warc.write_archives(pages)).collect()) == n
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), chat.text_parts("text").alias("parts"), "_x")
    assert len(chat.read_back(chat.format_chat(turns)).collect()) == docs.select("doc_id").distinct().count()


def test_pieces_follow_the_pattern():
    pattern, pick = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(400):
        texts = ["".join(pick.choice(" \n\t's'reтlvmd1²x.! 　é漢😀\x1c\x85A") for _ in range(pick.randint(0, 12))) for _ in range(4)]
        cut = pieces.cut_pieces(texts)
        vocabulary = [x.as_py().decode() for x in cut.vocabulary]
        found = [[vocabulary[i] for i in cut.index[a:b]] for a, b in zip(cut.starts, cut.starts[1:])]
        assert found == [pattern.findall(text) for text in texts]


@pytest.fixture(scope="module")
def texts(docs):
    pick = random.Random(2)
    made = ["a" * 1500, "ACGT" * 200, "漢字" * 100, "=" * 300, "", "'re're", "<|endoftext|>"]
    return made + ["".join(pick.choice("abeinrst'漢 ") for _ in range(200)) for _ in range(10)] + [r.text for r in docs.limit(60).collect()]


def test_bpe_is_that_of_the_library(texts):
    coder = byte_bpe.Coder(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    packed = coder.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in packed] == [library.encode_ordinary(x) for x in texts]
    assert coder.decode(packed) == [x.encode() for x in texts]


def test_packing_encodes_as_the_library_and_fills(spark, texts):
    library = Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    texts = [*texts, f"a {end} b", end * 3, f"{end}\n x{end[:-1]}", f" {end[1:]}  {end}'s {end}", f"é{end}é"]
    ids, begins = packing.Encoder(VOCABULARY).encode(texts)
    expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = packing.token_pieces(docs, "text", VOCABULARY, 2, 64)
    rows = packing.pack_best_fit(cut, 64).collect()
    for n, want in enumerate(expected):
        own = sorted((r for r in rows if r.doc_id == n), key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == [*want, 2]
        assert all(r.length == 64 for r in own[1:]) and [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    for sequence in {r.sequence_id for r in rows}:
        end = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def test_plan_needs_no_more_than_best_fit_one_by_one():
    pick = random.Random(4)
    for _ in range(50):
        counts = {n: pick.randint(1, 9) for n in pick.sample(range(1, 41), 15)}
        places = packing.plan(counts, 40)
        used = set()
        for place, after in zip(places, [*places[1:], None]):
            more = after and after.length == place.length
            docs = (after.rank if more else counts[place.length]) - place.rank
            used |= {place.first + i // place.each for i in range(docs)}
        assert len(used) == best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], 40)


def simhash_by_brute_force(rows):
    by = {}
    for doc, text in rows:
        by.setdefault(simhash.fingerprint(text, 3), []).append(doc)
    nodes = list(by)
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for x in nodes:
        for doc in by[x]:
            if doc is not None:
                least[root(x)] = min(least.get(root(x), doc), doc)
    return sorted(((d, simhash.fingerprint(t, 3), least.get(root(simhash.fingerprint(t, 3)))) for d, t in rows), key=str)


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash_components(spark, docs, odd, bucket):
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    near = [(10_000 + n, " ".join(f"w{i}" for i in range(400)) + f" x{n}") for n in range(60)]
    table = table.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    found = simhash.simhash_dedup(table, max_bucket=bucket).collect()
    found = sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found), key=str)
    assert found == simhash_by_brute_force([(r.doc_id, r.text) for r in table.collect()])


def test_fingerprint_hash_is_that_of_spark(spark):
    want = spark.sql("SELECT xxhash64('a b c') AS h").first().h % (1 << 64)
    assert simhash.fingerprint("A b\tC", 3) == want


def cut_by_brute_force(rows, n=13):
    last, first = 1 << 63, {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - n + 1):
            key = tuple(words[i : i + n])
            first[key] = min(first.get(key, last), last if doc is None else doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if first[tuple(words[i : i + n])] < (last if doc is None else doc):
                gone[i : i + n] = [True] * n
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [50_000, 60])
def test_substring_dedup(spark, shard):
    pick = random.Random(5)
    words = ["a", "b", "cc", "é", "d|"]
    rows = [
        (pick.choice([None, *range(30)]), None if pick.random() < 0.05 else " ".join(pick.choice(words[: pick.randint(1, 5)]) for _ in range(pick.choice([0, 5, 13, 20, 60, 200]))))
        for _ in range(90)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.substring_dedup(df, normalise=True, bits=1 << 12, shard_words=shard).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in found), key=str) == cut_by_brute_force(rows)


FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in values) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_by_brute_force(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(FIXED.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found)


def test_pii(spark, docs):
    made = [
        "a@b.c%d@e.f x@y.z@w.v", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 1",
        "+1 (555) 123-4567.... +44 20 7946 0958-", "é😀 a@b.co 漢 +1 555 123 4567", None, "", "+1+1+1", "1 " * 2000, "1" * 4000, "a.b" * 900 + "@x.y",
    ]
    df = spark.createDataFrame([(-1 - n, text) for n, text in enumerate(made)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.find_spans(df).collect():
        assert [tuple(s) for s in r.base] == base_by_brute_force(texts[r.doc_id])
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(0).alias("listed"), F.lit("ip").alias("kind"), F.lit(b).cast("long").alias("end")) for a, b in ((1, 3), (2, 4), (6, 7))])
    assert spark.range(1).select(pii.redact(F.lit("é23456789"), spans)).first()[0] == "é[IP]56[IP]89"


def test_pii_copies_of_one_candidate_leave_the_others_in_the_fit(spark):
    single = spark.range(2000).select(F.format_string("a%d@b.co", "id").alias("hit")).orderBy(F.xxhash64("hit", F.lit(""), F.lit(""))).first().hit
    made = [single] * 300 + [f"some words {n} and name{n}@host{n}.org behind" for n in range(60)]
    made += [f"the part {n} has {1000000 + n} lines" for n in range(60)]
    asked = [f"and so person{n} (at) place{n} (dot) org it is" for n in range(10)]
    df = spark.createDataFrame(list(enumerate(asked + made)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_spans(df, max_fit=200).collect()}
    assert all(len(found[n].spans) > len(found[n].base) for n in range(len(asked)))


def test_pii_threshold_is_that_of_all_settled_candidates(spark):
    # Of 4,000 harmless candidates 100 look like half of the 400 personal ones.
    looks = [(1.0, 2.0)] * 200 + [(1.0, 1.0)] * 200 + [(0.0, 1.0)] * 100 + [(0.0, 0.0)] * 3900
    rows = [(label, f"hit {n}", "", "", look) for n, (label, look) in enumerate(looks)]
    df = spark.createDataFrame(rows, "label double, hit string, before string, after string, look double")
    for max_fit in (60, 10_000):
        model, threshold = pii._fit(df, ["look"], max_fit, 0.99)
        vectors = pii.VectorAssembler(inputCols=["look"], outputCol="vector").transform(df)
        chosen = model.transform(vectors).filter(pii.vector_to_array("probability")[1] >= threshold).groupBy("look").count().collect()
        assert [tuple(r) for r in chosen] == [(2.0, 200)]


def test_warc_round_trip_with_magic_inside(spark):
    fake = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/é\r\nx", "<p>1"), (2, None, "<p>1"), (3, "u", None), (4, "u", ""), (6, "u", fake * 2), (7, "u", "x WARC/1.0\r\n" * 3), (8, "u", "\r\n\r\nWARC/1.0\r\n")]
    folder = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    want = {page: (len((html or "").encode()), base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()) for page, _, html in rows}
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (saved, "200"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = warc.read_archives(spark, folder).collect()
            assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in found} == want
            assert {r.page_id: r.refers_to for r in found if r.record_type == "revisit"} == {2: 1, 4: 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_warc_whatever_the_splits_of_the_second_read(spark):
    fake = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(n, "u", f"{n} {fake * (n % 4)}x WARC/1.0\r\n {'y' * (n * 7)}") for n in range(40)]
    folder = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {(n, len(html), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()) for n, _, html in rows}
    try:
        for first, second in (("1000", saved), (saved, "700")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            records = warc.read_archives(spark, folder)
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in records.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_warc_fails_rather_than_lose_a_record(spark):
    rows = [(1, "u", "a WARC/1.0\r\n b"), (2, "u", "c")]
    folder = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    every = warc.candidates(spark, folder)
    torn = every.join(warc.reachable(every), ["file", "offset"], "left_semi").filter("digest IS NULL").select("file", "offset", "next")
    assert warc._mended(spark, folder, every, torn).count() == 1
    other = every.withColumn("content", F.lit(b"other"))
    with pytest.raises(Exception, match="archive changed"):
        warc._mended(spark, folder, other, torn).collect()


def test_chat_is_reversible():
    pick = random.Random(3)
    atoms = [*chat.CONTROL, "<", "\\", "[", "/", "|", "a", "\n", "INST]", "|end|>"]
    for _ in range(3000):
        text, role = ("".join(pick.choice(atoms) for _ in range(pick.randint(0, 7))) for _ in range(2))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        turn = chat.format_turn(role, [{"type": "text", "text": text}], True)
        assert chat.parse_turns(turn["formatted"] * 2) == [(role, text)] * 2
        assert chat.unescape(turn["formatted"][turn["loss_start"] : turn["loss_end"]]) == text


def test_chat_parts_become_placeholders():
    blank = dict.fromkeys(chat.PART.names)
    parts = [blank | {"type": "text", "text": "see "}, blank | {"type": "image", "ref": "a.png", "width": 28, "height": 15}, None, blank | {"type": "audio", "ref": "b.wav", "seconds": 2.0}, blank | {"type": "odd"}]
    turn = chat.format_turn("user", parts, False)
    assert turn["formatted"] == "<|turn|>user<|says|>see <|image|><|audio|>[odd]<|end|>" and turn["loss_start"] is None
    assert [(a["ref"], a["tokens"]) for a in turn["attachments"]] == [("a.png", 4), ("b.wav", 50)]
    assert all(turn["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in turn["attachments"])


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    bad = [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [1.0]), (None, [1.0] * 64), (-6, [None] * 64)]
    table = table.unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    copies = table.filter("vec_id = 100").select(F.explode(F.sequence(F.lit(10**6).cast("long"), F.lit(10**6 + 19).cast("long"))).alias("vec_id"), "embedding")
    table = table.unionByName(copies)
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in table.collect() if r.vec_id is not None and (r.vec_id >= 0)]
    matrix, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    found = {}
    for r in sorted(neighbours.nearest(table, F.col("id") % 50 == 0, leaf_rows=128).collect()):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for i, v in rows:
        if i % 50 == 0:
            score = neighbours.cosines(matrix, v)
            best = [ids[j] for j in np.lexsort((ids, -score)) if ids[j] != i][:5]
            hits += len(set(best) & {x for x, _ in found[i]})
            total += 5
            assert all(s == score[ids == x][0] for x, s in found[i])
    assert hits / total >= 0.9
    assert [x for x, _ in found[100]][:2] == [10**6, 10**6 + 1]


def test_classifier_held_out(spark):
    scored = entry.LLM_QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("max_labelled", [50, 10_000])
def test_classifier_threshold_is_that_of_all_labelled(spark, docs, max_labelled):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~quality_model.held_out())
    model = quality_model.fit(docs, labels, max_labelled=max_labelled)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    value = np.sort(quality_model.worth(np.array([quality_model.text_features(r.text) for r in rows]), model))
    share, n = sum(r.quality == 0 for r in rows) / len(rows), len(rows)
    low, high = (int(np.clip((share + d) * n, 1, n - 1)) for d in (-0.02, 0.02))
    at = low + int(np.argmax(np.diff(value[low - 1 : high + 1])))
    assert model.threshold == pytest.approx((value[at - 1] + value[at]) / 2, abs=1e-12)
    assert abs((value < model.threshold).mean() - share) <= 0.03


def test_widest_gap_over_slices(spark):
    pick = np.random.default_rng(3)
    for n, share in ((2, 0.5), (3, 0.9), (50, 0.01), (50, 0.5), (5000, 0.3), (5000, 0.98)):
        value = np.sort(pick.normal(size=n).round(1 if n == 50 else 3))
        low, high = (int(np.clip((share + d) * n, 1, n - 1)) for d in (-0.02, 0.02))
        at = low + int(np.argmax(np.diff(value[low - 1 : high + 1])))
        df = spark.createDataFrame([(float(x),) for x in value], "worth double").repartition(8)
        for aqe in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            try:
                assert quality_model.widest_gap(df, share) == pytest.approx((value[at - 1] + value[at]) / 2)
            finally:
                spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert quality_model.widest_gap(spark.range(100).select(F.lit(2.5).alias("worth")), 0.3) == 2.5


def test_frequent_lines_go(spark):
    rows = [(n, f"boiler plate line {n}\nown words are " + " ".join(chr(97 + n % 26) * (2 + n // 26) + chr(97 + i) for i in range(12 if n else 1)), "h") for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality_rules.quality_rules(df, min_docs=10).collect()}
    assert found[1].kept and found[1].kept_words == found[1].n_words - 4 and not found[0].kept
    text = spark.range(1).select(quality_rules.without_lines(F.lit(rows[1][1]), F.lit(found[1].removed_lines))).first()[0]
    assert text == rows[1][1].split("\n")[1]


def test_pipeline_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
        if name == "simhash_dedup":
            rows = simhash_by_brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in kept.collect()} == {c for _, _, c in rows}
        if name == "substring_dedup":
            rows = cut_by_brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: " ".join(w.decode() for w in r.text.encode().split()) for r in kept.collect()} == {d: t for d, _, _, t in rows}
        if name == "pii":
            assert not any(base_by_brute_force(r.text) for r in kept.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}


CLASHING = (
    "_mark", "_id", "_of", "_doc", "_packed", "_starts", "_row", "_rank", "spans", "score", "n_words", "n_removed", "fingerprint",
    "component", "component_id", "features", "_text", "_low", "base", "other 0", "a.b", "low", "anchor", "key", "mark", "last",
)


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_takes_odd_rows(spark, odd, empty):
    kept = odd.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    kept = kept.select("*", *[F.concat_ws(":", F.lit(name), "doc_id").alias(name) for name in CLASHING])
    names = kept.columns
    kept = kept.limit(0) if empty else kept
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == names
        for row in kept.collect():
            assert all(row[name] == (name if row.doc_id is None else f"{name}:{row.doc_id}") for name in CLASHING)
    assert (kept.count() == 0) == empty
    assert (corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() == 0) == empty


def test_names_of_other_columns_do_not_matter(spark, odd):
    docs = odd.select("doc_id", "text", *[F.concat_ws(":", F.lit(name), "doc_id").alias(name) for name in CLASHING if name != "a.b"])
    own = {"n_words", "n_removed"}
    cut = packing.token_pieces(docs, "text", VOCABULARY, 2, 64).drop("ids")
    for found, made in ((substring_dedup.substring_dedup(docs, bits=1 << 12), own), (packing.pack_best_fit(cut, 64), set())):
        assert set(docs.columns[2:]) <= set(found.columns)
        rows = found.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        for row in rows:
            assert all(row[name] == (name if row.doc_id is None else f"{name}:{row.doc_id}") for name in docs.columns[2:] if name not in made)
