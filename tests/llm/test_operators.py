"""The operators on small tables against brute force, with nulls, empty, long, equal and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dispatchflow.llm import bpe, chat, exact, packing, pages, quality, sharding, simhash, suffix, toxicity
from dispatchflow.llm.graph import components
from dispatchflow.llm.queries import ORACLE

PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = chat.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
SCHEMA = "doc_id bigint, text string, lang string, digest string, keep_id int, __key string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _texts():
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "d'été", "straße", "I'll", "x9", "ΟΔΟΣ", "naïve", "the", "of", "and", "to"]
    base = [" ".join(draw.choices(words, k=n)) for n in (12, 40, 90, 200, 400, 30)]
    near = base[3].replace("alpha", "omega", 1)
    long = " ".join(draw.choices(words, k=30_000))
    shared = base[4][:300]
    rows = [None, "", " \t\n", "one", *base, base[1], base[1].replace(" ", "\n ", 2), near, long, "a" * 5000]
    rows += [f"{draw.random()} {shared} {draw.random()}" for _ in range(6)] + ["<|endoftext|> x\x1cy z", base[2], None]
    return rows


@pytest.fixture(scope="module")
def rows():
    found = [(i * 7 % 101, t, ["en", None, "xx", "fr"][i % 4], "d", 1, "k") for i, t in enumerate(_texts())]
    return [*found, found[8]]  # one row twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, none, rows):
    groups = {}
    for identifier, text, *_ in rows:
        groups.setdefault(SPACE.sub(" ", text or ""), []).append(identifier)
    want = sorted((i, min(g), len(g), i == min(g)) for g in groups.values() for i in g)
    for support in (0.001, 0.2):  # without and with frequent digests
        found = exact.exact_groups(docs, support=support).select("id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, found)) == want
        kept = exact.drop_exact(docs, support=support)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact.exact_groups(none).count() == exact.drop_exact(none).count() == 0


def test_frequent_digests_early_in_every_partition(spark):
    """A third of the rows, then 2 % of the rows, each before thousands of others in its partition."""
    for copies in (1000, 60):
        texts = [t for part in range(3) for t in ["hot"] * copies + [f"{part} {i}" for i in range(2000)]]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 3), "id int, text string")
        found = exact.frequent_digests(docs.select("id", exact.text_digest(docs.text).alias("digest")), 0.01).collect()
        want = (hashlib.sha256(b"hot").digest(), 0, 3 * copies)
        assert [(bytes(r.digest), r.keep_id, r.group_size) for r in found] == [want]


def test_exact_sql(spark, docs):
    database = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()
    database.register("documents", documents)
    want = sorted(database.execute(ORACLE["op10_exact"]).fetchall(), key=str)
    found = exact.exact_groups(docs).selectExpr("id", "keep_id", "group_size", "kept", "lower(hex(digest))")
    assert sorted(map(tuple, found.collect()), key=str) == want


def _print(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    """Smallest id reachable over links of at most two bits."""
    above = {i: i for i in prints}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            a, b = sorted((top(a), top(b)))
            above[b] = a
    return {i: top(i) for i in prints}


def test_simhash_components(docs, none, rows):
    prints = {i: _print(t, 3) for i, t, *_ in rows}
    found = simhash.near_components(docs, size=3).collect()
    assert {r.id: r.print % (1 << 64) for r in found} == prints
    assert {r.id: r.component_id for r in found} == _classes(prints)
    assert len(found) == len(rows)
    assert simhash.near_components(none, size=3).count() == 0


@pytest.mark.parametrize("pairwise", [1, 4, 128])
def test_links_join_all_within_two_bits(spark, pairwise):
    draw = random.Random(3)
    prints = {}
    for base in (draw.getrandbits(64) for _ in range(5)):
        for _ in range(25):
            value = base
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                value ^= 1 << bit
            if value not in prints.values():
                prints[len(prints)] = value
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()], "print bigint, id bigint")
    roots = {r.node: r.root for r in components(simhash.links(frame, pairwise=pairwise)).collect()}
    assert {i: roots.get(i, i) for i in prints} == _classes(prints)


def test_near_documents_leave_one(spark, docs, none, rows):
    """Of each class of the brute-force links the smallest id stays; null ids stay, rows of one id go together."""
    prints = {}
    for identifier, text, *_ in rows:
        prints[identifier] = _print(text, 3)
    want = sorted(i for i, top in _classes(prints).items() if i == top)
    kept = simhash.drop_near(docs, size=3)
    assert kept.columns == docs.columns
    assert len(want) < len(prints)
    assert sorted({r.doc_id for r in kept.collect()}) == want
    assert kept.where("doc_id = 49").count() == sum(r[0] == 49 for r in rows) * (49 in want)
    assert simhash.drop_near(none).count() == 0
    without_id = [(None, "some words of no one", "en", "d", 1, "k"), (5, "some words of no one", "en", "d", 1, "k")]
    found = simhash.drop_near(spark.createDataFrame([*without_id, (7, "some words of no one", "en", "d", 1, "k")], SCHEMA))
    assert sorted((r.doc_id is None, r.doc_id) for r in found.collect()) == [(False, 5), (True, None)]


# Columns that are called as the operators call theirs.
CLASHING = "doc_id bigint, text string, lang string, id bigint, __id bigint, __ID_ int, __digest string, __kept int, digest binary, __content bigint, __places string, content int, kept int, n_words int, row int, place int"


@pytest.mark.parametrize(
    "stage", [exact.drop_exact, quality.keep_good, simhash.drop_near, suffix.drop_repeats], ids=lambda f: f.__name__
)
def test_columns_that_clash(spark, stage):
    """Stages of the pipeline keep all columns whatever they are called, and their decisions are the same."""
    words = [f"word{i} of the line" for i in range(60)]
    texts = [" ".join(words[:40]), " ".join(words[:40]), " ".join(words[10:50]), None, "", " ".join(words[:40])]
    more = (3, 4, 5, "d", 6, b"x", 7, "p", 8, 9, 10, 11, 12)
    made = [(i, t, "en", *more) for i, t in zip([1, 2, 3, 4, 5, 2], texts, strict=True)]
    rows = spark.createDataFrame(made, CLASHING)
    found = stage(rows)
    assert found.columns == rows.columns
    plain = stage(rows.select("doc_id", "text", "lang"))
    assert sorted(map(str, found.select("doc_id", "text", "lang").collect())) == sorted(map(str, plain.collect()))
    assert all(tuple(r)[3:] == tuple(bytearray(x) if isinstance(x, bytes) else x for x in more) for r in found.collect())
    assert stage(rows.limit(0)).count() == 0


def _repeat_words(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)})


def test_quality_counts(docs, none, rows):
    found = {r.id: r for r in quality.judged(docs).collect()}
    for identifier, text, *_ in rows:
        own, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = own.split("\n")
        with_word = [bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines]
        r = found[identifier]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", own))
        assert r.n_dup_lines == sum(w and x in lines[:i] for i, (x, w) in enumerate(zip(lines, with_word, strict=True)))
        assert r.n_repeat_words == _repeat_words(words)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.judged(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_divergence_finds_tables_and_spares_prose(spark):
    draw = random.Random(6)
    prose = [" ".join(draw.choices(["the", "of", "and", "in", "to", "house", "river", "runs"], k=200)) for _ in range(30)]
    prose = [" ".join(f"{w}{draw.randrange(90)}" if w in ("house", "river") else w for w in p.split()) for p in prose]
    odd = " | ".join(f"{draw.randrange(10**6)}" for _ in range(200))
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*prose, odd])], "doc_id int, text string, lang string")
    kept = {r.id for r in quality.judged(frame).where("kept").collect()}
    assert kept == set(range(30))


def test_every_language_has_a_reference(spark):
    draw = random.Random(8)
    prose = [" ".join(draw.choices(["kaj", "la", "Hundo", "kuris", "rapide,", "hejmen."], k=150)) for _ in range(20)]
    odd = " | ".join(f"{draw.randrange(10**6)}" for _ in range(200))
    texts = [*prose, odd, None, "kaj", prose[0]]
    rows = [(i, t, lang) for lang, first in (("eo", 0), (None, 100), ("en", 200)) for i, t in enumerate(texts, first)]
    frame = spark.createDataFrame([*rows, (300, odd, "zz")], "doc_id int, text string, lang string")
    found = {r.id: r for r in quality.judged(frame).collect()}
    assert len(found) == len(rows) + 1
    counts = {r.id: np.array(r.classes, float) for r in quality.features(frame).collect()}
    for lang, first in (("eo", 0), (None, 100), ("en", 200)):
        total = sum(counts[first + i] for i in range(len(texts)))
        for i in range(len(texts)):
            r = found[first + i]
            assert (r.class_distance is None) == (i in (21, 22)) and (r.common_distance is None) == (lang != "en" or i in (21, 22))
            if r.class_distance is not None:
                p, q = counts[r.id] / counts[r.id].sum(), total / total.sum()
                halves = [sum(a * np.log2(a / ((a + b) / 2)) for a, b in zip(x, y, strict=True) if a) for x, y in ((p, q), (q, p))]
                assert r.class_distance == pytest.approx(np.sqrt(sum(halves) / 2))
        assert found[first + 20].class_distance > 0.25 and not found[first + 20].kept
        assert all(found[first + i].class_distance < 0.25 for i in range(20))
    assert found[5].kept and found[105].kept and found[300].class_distance == pytest.approx(0, abs=1e-6)


def test_js_distance():
    same = quality.js_distance(np.array([[1.0, 3.0], [0.0, 0.0], [4.0, 0.0]]), np.array([10.0, 30.0]))
    assert same[0] == pytest.approx(0, abs=1e-7) and same[1] == 0 and 0 < same[2] < 1
    assert quality.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1)


def test_shards_are_even_and_keep_groups(spark, docs, none, rows):
    found = sharding.shard_documents(docs, 4).collect()
    by = {s: sorted(r.slot for r in found if r.shard == s) for s in range(4)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert sorted((r.id, r.size, r.text_crc32) for r in found) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    assert sharding.shard_documents(none, 4).count() == 0
    pairs = spark.range(400).selectExpr("id as doc_id", "concat('t', id div 2) as text")
    shards = {r.id: r.shard for r in sharding.shard_documents(pairs, 4).collect()}
    start = sum((2 * i) % 4 == (2 * i + 1) % 4 for i in range(200))
    assert sum(shards[2 * i] == shards[2 * i + 1] for i in range(200)) > start + 120


def test_hot_group_fills_shards(spark):
    frame = spark.range(240).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    found = sharding.shard_documents(frame, 8).collect()
    assert sorted(sum(r.shard == s for r in found) for s in range(8)) == [30] * 8
    assert len({r.shard for r in found if r.id % 3 == 0}) <= 6


def _cut(rows, length=100):
    seen, want = {}, {}
    for identifier, text in sorted({(i, t or "") for i, t, *_ in rows}):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.setdefault(data[p : p + length], identifier)
        want[identifier] = bytes(x for x, g in zip(data, gone, strict=True) if not g)
    return want


@pytest.mark.parametrize("sorted_spans", [8192, 1])
def test_repeats_are_cut_exactly(docs, none, rows, sorted_spans):
    found = suffix.cut_repeats(docs, sorted_spans=sorted_spans).collect()
    assert {r.id: bytes(r.kept) for r in found} == _cut(rows)
    assert len(found) == len(rows)
    assert suffix.cut_repeats(none).count() == 0


def test_dropped_repeats_leave_whole_characters(docs, rows):
    found = suffix.drop_repeats(docs)
    assert found.columns == docs.columns
    by = {r.doc_id: r.text for r in found.collect()}
    assert all((by[i] is None) == (t is None) for i, t, *_ in rows)
    assert "�" not in "".join(t or "" for t in by.values())


def test_suffixes_are_verified(monkeypatch):
    draw = random.Random(1)
    pieces = [bytes(draw.choices(b"ab", k=160)) for _ in range(40)]
    pieces += [p[:20] + pieces[0][20:] for p in pieces[1:12]]

    def groups(hashes):
        return [
            suffix._Suffix(p, (0 << 16) | (59 << 8) | 40, (i,), memoryview(hashes[i])) for i, p in enumerate(pieces)
        ]

    good = suffix._prefix_hashes(pieces, [40] * len(pieces))
    want = set(suffix.repeated_strings(groups(good), 100))
    assert want
    colliding = np.zeros_like(good)  # every prefix seems equal: only verification tells them apart
    assert set(suffix.repeated_strings(groups(colliding), 100)) == want


def test_encoding_is_the_librarys(docs, none, rows):
    library = Tokenizer.from_file(PATH)
    found = {r.id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for identifier, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert bpe.ids_of(found[identifier].ids) == ids
        assert found[identifier].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, PATH).count() == 0


def test_chunks_are_reused_and_joins_agree():
    own = bpe.Encoder(PATH)
    draw = random.Random(2)
    shared = " ".join(f"word{draw.randrange(999)}" for _ in range(3000)).encode()
    texts = [f"start{i} ".encode() * i + shared for i in range(4)] + [shared.replace(b" ", b"")]
    for data in texts:
        assert own.chunked(data) == own.encoded(data)
    assert own.reused_chunks > own.encoded_chunks


def test_words_learned_at_once_are_the_librarys(rows):
    draw = random.Random(9)
    letters = "abcdefgABCÀÉßÿñ019.,'$#-<|>日\0\x1c\x85é"
    made = [" ".join("".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(200)) for _ in range(40)]
    texts = [t or "" for _, t, *_ in rows] + made + ["I'll 's '' ''s don't", "x" * 300 + " y", "<|endoftext|>a", "e\u0301 ª"]
    own = bpe.Encoder(PATH)
    assert own.ranks is not None
    own.words.most = 100  # generations turn while words are learned
    for some in (texts, texts[:9]):
        found = own.plain_many([t.encode() for t in some])
        assert found == [own.encoded(t.encode()) for t in some]


def test_each_different_word_is_encoded_once(monkeypatch):
    own = bpe.Encoder(PATH)
    asked = []
    by_ranks = bpe.Encoder._by_ranks
    monkeypatch.setattr(bpe.Encoder, "_by_ranks", lambda self, words: asked.extend(words) or by_ranks(self, words))
    own.words.most = 2  # as if the memory were too small for the texts
    texts = ["ab cd Ef.", None, "", " \t\n\v\f\rcd ab\x1cx \x85 a\xa0b", "cd  cd " * 50, "<|endoftext|> 日本", "x" * 500]
    for array in (pa.array(texts), pa.array(["cut", *texts, "cut"], pa.large_string()).slice(1, len(texts))):
        asked.clear()
        assert own.plain_many(array) == [own.encoded((t or "").encode()) for t in texts]
        assert asked and len(asked) == len(set(asked))
    assert own.plain_many(pa.array([], pa.string())) == []


def test_every_token_is_encoded_as_itself():
    own = bpe.Encoder(PATH)
    end = "</w>"
    for token, i in own.tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(end) and not token.startswith("<|"):
            assert [t.id for t in own.tokenizer.model.tokenize(token[: -len(end)])] == [i]


def test_packing_covers_every_id_once(docs, none, rows):
    library = Tokenizer.from_file(PATH)
    want = {}
    for identifier, text, *_ in rows:
        want.setdefault(identifier, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    pieces = packing.pack(docs, PATH).collect()
    covered, sequences = {}, {}
    for p in pieces:
        ids = want[p.id][0]
        part = np.array(ids[p.start : p.start + p.length], "<u4")
        assert (p.ids_crc32, p.doc_tokens) == (zlib.crc32(part.tobytes()), len(ids))
        covered.setdefault(p.id, []).extend(range(p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {i: sorted(x) for i, x in covered.items()} == {
        i: sorted(k for ids in texts for k in range(len(ids))) for i, texts in want.items()
    }
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(none, PATH).count() == 0


def test_neighbours_share_rare_terms():
    texts = [np.array([1, 2, 3, 50 + i % 5, 60 + i % 5], np.uint16) for i in range(40)]
    held = np.bincount(np.concatenate(texts), minlength=100)
    idf = np.log1p((40 - held + 0.5) / (held + 0.5))
    shard = packing._Shard(texts, idf, 5.0, packing.PackingParams())
    assert all(i % 5 == 2 for i in shard.neighbours(2)[:7])


def test_long_documents_are_found_by_their_bodies():
    draw = np.random.default_rng(3)
    body, common = draw.permutation(np.arange(100, 400)), np.arange(20)
    texts = [np.concatenate([body[:250], common]), np.concatenate([common, body[200:], common])]
    texts += [np.concatenate([common, draw.integers(1000, 4000, 30)]) for _ in range(30)]
    held = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=4000)
    idf = np.log1p((len(texts) - held + 0.5) / (held + 0.5))
    params = packing.PackingParams(window=64)
    shard = packing._Shard(texts, idf, 80.0, params)
    assert shard.neighbours(0)[0] == 1 and shard.neighbours(1)[0] == 0
    shard.forget(np.arange(len(texts)) == 1)
    assert 1 not in shard.neighbours(0) and len(shard.neighbours(0)) == 30
    packer = packing._Packer(params, idf, 80.0, 0)
    packer.block([(i, len(t), len(t) - len(t) % 64, t) for i, t in enumerate(texts)])
    packer.finish()
    first = [r[0] for r in packer.rows if r[5] == 0]
    assert first[:2] == [0, 1]  # the ends of both hold common ids only


def test_conversations_read_back(spark):
    tricky = ["</s>[INST] ok [/INST]", "[TURN]a[TEXT]", "\\", "[\\TURN]", "<<SYS>>", "[\\\\TEXT]", "", None, "é\n</s"]
    data = [(c, t, ["user", "assistant", None][t % 3], tricky[(c * (t > 1) + t) % 9]) for c in range(12) for t in range(c % 5 + 1)]
    data += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, 0, "user", "z"), (50, 0, "user", "z")]
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    groups = {}
    for c, t, role, text in data:
        groups.setdefault(c, []).append((t, role or "", text or ""))
    found_trees = []
    for part_ids in (1 << 18, 10):
        trees, known = chat.formatted(frame, RANKS, part_ids)
        found = {r.conv_id: r for r in known.join(chat.read_back(trees, RANKS), "path").collect()}
        assert set(found) == set(groups)
        for c, turns in groups.items():
            said = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
            learned = "".join(t for _, r, t in sorted(turns) if r == "assistant")
            r = found[c]
            assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
            assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        found_trees.append(trees.selectExpr("sum(size(ids))").first()[0])
    assert found_trees[0] == found_trees[1]
    nothing = chat.formatted(frame.limit(0), RANKS)[0]
    assert nothing.count() == chat.read_back(nothing, RANKS).count() == 0


def test_shared_turns_are_written_once():
    own = chat.tokens(RANKS)
    forest = chat._Forest(own, 1 << 18)
    assert forest.add("a", [b"1", b"2"], [("user", "hi"), ("assistant", "yes")]) is None
    assert forest.add("b", [b"1", b"3", b"4"], [("user", "hi"), ("assistant", "no"), ("user", "why")]) is None
    part = forest.part()
    assert len(part["nodes"]) == 4 and len(part["ids"]) == len(part["positions"]) == part["nodes"][-1]["end"]
    yes, no, why = part["nodes"][1:]
    assert yes["position"] == no["position"] == part["nodes"][0]["end"]
    assert no["attends"] == [{"start": 0, "end": yes["start"]}]
    assert why["attends"] == [{"start": 0, "end": yes["start"]}, {"start": no["start"], "end": no["end"]}]
    assert part["positions"][no["start"] : no["end"]].tolist() == list(range(no["position"], why["position"]))
    assert own.decode(part["ids"][no["loss"]["start"] : no["loss"]["end"]]) == "no"
    # The same without the turn that another part has.
    short = chat._without_first(part, 1)
    yes, no, why = short["nodes"]
    assert [n["held"] for n in (yes, no, why)] == [1, 1, 1] and [n["parent"] for n in (yes, no, why)] == [None, None, 1]
    assert yes["attends"] == no["attends"] == [] and why["attends"] == [{"start": no["start"], "end": no["end"]}]
    assert short["held"][0]["length"] == yes["position"] and yes["start"] == 0
    assert own.decode(short["ids"][no["loss"]["start"] : no["loss"]["end"]]) == "no"


@pytest.mark.parametrize(("tasks", "part_ids"), [(1, 1 << 18), (4, 1 << 18), (32, 1 << 18), (32, 40)])
def test_no_turn_of_a_path_is_written_twice(spark, tasks, part_ids):
    """All conversations share a turn, groups of them share three more, in many tasks and parts."""
    convs = {}
    for c in range(300):
        shared = [("user", "all of us"), ("assistant", f"a{c % 7}"), ("user", f"b{c % 21}"), ("assistant", f"c{c % 42}")]
        convs[c] = shared[: 1 + c % 5] + [("user", f"own {c % 100}")] * (c % 3)
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(tasks)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        trees, known = chat.formatted(frame, RANKS, part_ids)
        parts = trees.collect()
        found = {r.conv_id: r.turns_sha256 for r in known.join(chat.read_back(trees, RANKS), "path").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    keys = [bytes(n.key) for p in parts for n in p.nodes]
    assert len(keys) == len(set(keys)) == len({tuple(t[:n]) for t in convs.values() for n in range(1, len(t) + 1)})
    assert (len(parts) > 4) == (tasks > 4)
    for c, turns in convs.items():
        assert found[c] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    own = chat.tokens(RANKS)
    where = {bytes(n.key): (p, n) for p in parts for n in p.nodes}
    for p in parts:
        for n in p.nodes:
            # Positions go on from the turn above, in whichever part it is.
            if n.parent is not None:
                above = p.nodes[n.parent]
                assert n.position == above.position + above.end - above.start and n.held == above.held
            elif n.held:
                above = p.held[n.held - 1]
                assert n.position == above.position + above.length
                there, node = where[bytes(above.key)]
                assert (node.position, node.end - node.start) == (above.position, above.length)
                assert own.decode(np.array(there.ids[node.start : node.end])).endswith(chat.END)
            else:
                assert n.position == 0
            assert p.positions[n.start : n.end] == list(range(n.position, n.position + n.end - n.start))
            seen = sum(s.end - s.start for s in n.attends) + sum(h.length for h in p.held[: n.held])
            assert seen == n.position


def test_long_and_odd_texts_come_back():
    own = chat.tokens(RANKS)
    for text in ("", "<|endoftext|>", " " * 1_000_000, "a" * 200_000, "中\n" * 70_000, "é\t\r\n \u3000x\U0001f600\x00</s>"):
        assert own.decode(own.encode(text)) == text


def test_escapes_are_reversible():
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choices(["\\", "<", "[", "TURN]", "TEXT]", "/s>", "s>", "a", *chat.CONTROL], k=6))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies &amp; more.</div><article><h1>Head&nbsp;line</h1><p>One <b>bo</b>ld &lt;word&gt;.<br>Next
<p>Two.<script>var x="<p>no</p>";</script><div class="advert">Buy now and save a lot of money on all of it.</div></article>
<section class="comments"><p>I think that this is a very long comment of a reader.</p></section><footer>&copy; us</footer>"""


def test_main_text(spark):
    frame = spark.createDataFrame(
        [(1, PAGE, 2), (2, None, 2), (3, "", 2), (None, PAGE, 2), (1, PAGE, 2), (4, "<p", 1), (5, "<div>" * 3000, 1)],
        "page_id bigint, html string, text int",
    )
    want = "Head line One bold <word>. Next Two."
    found = [(r.id, r.text) for r in pages.extracted(frame).collect()]
    assert sorted(found, key=str) == sorted([(1, want), (2, ""), (3, ""), (None, want), (1, want), (4, ""), (5, "")], key=str)
    assert pages.extracted(frame.limit(0)).count() == 0


def test_marginals_are_exact():
    nodes, _ = pages.tree("<html><body><div><p>a b</p></div><article><p>c</p></article></body></html>")
    model = pages.train([(p, False, 1.0) for p in pages.LABELLED])
    found = model.marginals(nodes)
    odds = [sum(model.odds.get(s, 0.0) for s in seen) for seen in pages.observed(nodes)]
    total, ones = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        weight = model.root[states[0]]
        for i, state in enumerate(states):
            p = 1 / (1 + np.exp(-odds[i]))
            weight *= p if state else 1 - p
            if i:
                weight *= model.edges[states[nodes[i].parent]][state]
        total += weight
        ones = [o + weight * s for o, s in zip(ones, states, strict=True)]
    assert found == pytest.approx([o / total for o in ones])


def test_segments_are_the_maximal_ones():
    def brute(scores):
        if not any(s > 0 for s in scores):
            return []
        best, at = max(
            ((sum(scores[i:j]), (i, j)) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
            key=lambda x: (round(x[0], 9), x[1][0] - x[1][1]),
        )
        i, j = at
        left = brute(scores[:i])
        right = [(a + j, b + j) for a, b in brute(scores[j:])]
        return [*left, (i, j - 1), *right]

    draw = random.Random(9)
    for _ in range(300):
        scores = [draw.choice([-0.5, -0.5, draw.uniform(0.1, 3), draw.uniform(-3, -0.6)]) for _ in range(12)]
        hits = [(i, s) for i, s in enumerate(scores) if s != -0.5]
        assert [(a, b) for a, b, _ in toxicity.segments(hits, -0.5)] == brute(scores)


def test_toxic_texts_are_found(spark):
    draw = random.Random(10)
    words = [f"word{i}" for i in range(300)]
    data = []
    for i in range(600):
        text = draw.choices(words, k=60)
        if i % 6 == 0:
            for _ in range(3):
                text[draw.randrange(60)] = draw.choice(["nasty", "vile", "awful"])
        data.append((i, " ".join(text), int(i % 6 == 0)))
    data += [(9000, None, 0), (9001, "", 0)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in data], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id bigint, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in data}
    assert all(r.predicted == truth[r.id] for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in found)
    blind = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(blind) == len(data) and all(0 <= r.score <= 1 for r in blind)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_of_odd_rows(spark):
    plain, bad = "good words of all kinds stand here " * 4, "nasty vile awful " * 8
    texts = [plain + f"x{i}" if i % 3 else bad + f"x{i}" for i in range(90)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, None), (500, plain * 4000), (501, bad * 4000)]
    docs = spark.createDataFrame([(i, t, 2.0, "s") for i, t in rows], "doc_id bigint, text string, label double, score string")
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (None, 1), (0, 1), (777, 0)]
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert sorted(str(r.id) for r in found) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert [r.held_out for r in found if r.id is None] == [False, False]
    first = [r.score for r in found if r.id == 0]
    assert len(first) == 2 and first[0] == first[1]
    by_id = {r.id: r.predicted for r in found if r.id in (500, 501)}
    assert by_id == {500: 0, 501: 1}
