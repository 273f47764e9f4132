"""Operators over documents against brute force, on odd rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, duck
from titletide.llm import exact, language, packing, pieces, queries, quality, repeats, reuse, sharding, simhash, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner int, key string, row string, block long"
PASSAGE = " ".join(f"word{i} of the passage" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "5"), (5, "one"), (6, "One"), (7, "ONE TWO three four five"),
    (8, "one two THREE four five"), (9, "é É ß ñ"), (10, "É é ß ñ"), (11, PASSAGE + " tail one"), (12, "head two " + PASSAGE),
    (12, "head two " + PASSAGE), (None, "no id at all"), (None, "no id at all"), (None, None), (13, "no id at all"),
    (14, "a<|endoftext|>b  c <|endoftext|> d"), (15, "x" * 30_000), (16, "long words and more " * 20_000), (17, "中文 文本 。 没有 空格"),
    (18, "tabs\tand\nlines \n  and   runs  of spaces   "), (19, "'s 're don't I'll   non-breaking　wide"), (-5, "negative"),
    (20, "zero\0byte"), (21, PASSAGE.upper()),
]


def frame(spark, rows=ODD):
    wide = [(d, t, "en", "s", None if t is None else len(t), 7, "k", "r", 3) for d, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def same(got, wanted):
    order = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, wanted), key=order)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates(spark):
    groups = defaultdict(list)
    for d, t in ODD:
        groups[low(t)].append(d)
    wanted = []
    for d, t in ODD:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        wanted.append((d, keep, len(ids), d == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    got = exact.exact_duplicates(frame(spark), capacity=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got.collect(), wanted)
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_colliding_keys_are_told_apart_by_bytes(spark, monkeypatch):
    index = exact.build_index(frame(spark).select("doc_id", "text"), 4, capacity=3)
    assert index.count() == len({low(t) for _, t in ODD})
    batches = [r for r in _owned([(0, 5, "a", b"x", 1, 2), (0, 5, "b", b"y", 4, 1), (0, 5, "a", b"x", 9, 1), (0, 6, "c", b"z", 3, 1)])]
    assert [(r["key"], r["chain"], r["keep_id"], r["group_size"]) for r in batches] == [(5, 0, 9, 3), (5, 1, 4, 1), (6, 0, 3, 1)]


def _owned(entries):
    import pyarrow as pa

    names, kinds = ("owner", "key", "text_sha256", "body", "keep_id", "copies"), ("i4", "i8", None, None, "i8", "i8")
    columns = [pa.array([e[i] for e in entries], {"i4": pa.int32(), "i8": pa.int64()}.get(k)) for i, k in enumerate(kinds)]
    for batch in exact._own(2)(iter([pa.RecordBatch.from_arrays(columns, names=list(names))])):
        yield from batch.to_pylist()


def test_directory_doubles_and_splits_overfull_buckets_only():
    keys = np.sort(np.array([0, 1, 2, 3, 1 << 62, 1 << 63, (1 << 63) + 1, *([9] * 5)], dtype=np.uint64))
    depth, buckets, depths = exact.grow_directory(keys, 3)
    assert depth == depths.max()
    for bucket in {(b, d) for b, d in zip(buckets.tolist(), depths.tolist())}:
        inside = [k for k, b, d in zip(keys.tolist(), buckets.tolist(), depths.tolist()) if (b, d) == bucket]
        assert len(inside) <= 3 or len(set(inside)) == 1
        assert all(bucket[1] == 0 or k >> (64 - bucket[1]) == bucket[0] for k in inside)
    assert exact.grow_directory(keys, 100)[0] == 0


def test_shards(spark):
    got = sharding.shard_by_bytes(frame(spark), shards=4).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got],
         [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ODD])
    ordered = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    assert [r.shard for r in ordered] == sorted(r.shard for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    total, at = sum(r.size for r in got), 0
    for r in ordered:
        assert r.shard == (2 * at + r.size) * 4 // (2 * total)
        at += r.size
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0


def simhash_of(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", low(text).encode())
    shingles = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(keys, close):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if close(keys[i], keys[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(keys))]


def test_simhash(spark):
    edits = [(100 + i, " ".join(w for j, w in enumerate(PASSAGE.split()) if j != 7 * i)) for i in range(12)]
    table = ODD + edits
    prints = [simhash_of(t) for _, t in table]
    roots = linked(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {r: min((table[i][0] for i in range(len(table)) if roots[i] == r and table[i][0] is not None), default=None) for r in roots}
    got = simhash.near_duplicates(frame(spark, table)).select("doc_id", "fingerprint", "component_id")
    same(got.collect(), [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(table, prints, roots)])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_every_pair_within_the_radius_meets():
    draw = random.Random(1)
    for radius in (1, 2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(5000):
            apart = sum(1 << p for p in draw.sample(range(64), draw.randint(1, radius)))
            assert any(not m & apart for m in masks)


def test_overfull_buckets_lose_no_link(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BUCKET", 16)
    draw = random.Random(2)
    base = draw.getrandbits(64)
    prints = sorted({base ^ sum(1 << p for p in draw.sample(range(20), draw.randint(0, 5))) for _ in range(300)})
    masks = simhash.covering_masks(4)

    def level(rows, finer):
        rows = sorted(rows)
        kinds = (pa.int32(), pa.int64(), pa.int64())
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:a + 40]], k) for i, k in enumerate(kinds)],
                                              names=["table_no", "value", "fp"]) for a in range(0, len(rows), 40)]
        return [r for b in simhash._meet(4, masks, finer)(iter(batches)) for r in b.to_pylist()]

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    first = level([(i, signed(p & m), signed(p)) for i, m in enumerate(masks) for p in prints], 0)
    again = level([(r["table_no"], r["value"], r["a"]) for r in first if r["b"] is None], 1)
    links = {(r["a"], r["b"]) for r in first + again if r["b"] is not None}
    close = lambda a, b: (a ^ b).bit_count() <= 4
    assert any(r["b"] is None for r in first)
    assert all(close(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links)
    wanted = linked(prints, close)
    ours = linked([signed(p) for p in prints], lambda a, b: (a, b) in links or (b, a) in links)
    assert len(set(zip(wanted, ours))) == len(set(wanted)) == len(set(ours))


@pytest.fixture(scope="module")
def library():
    made = pieces.Pieces(tokens.VOCABULARY, bytes)
    return lambda text: made.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, library):
    wanted = [(d, len((t or "").encode()), n := len(library(t)), n > 1024) for d, t in ODD]
    same(tokens.token_counts(frame(spark)).collect(), wanted)
    assert tokens.token_counts(frame(spark, [])).count() == 0


def test_pieces_are_exact_on_odd_texts(library, monkeypatch):
    draw = random.Random(3)
    parts = ["a", "b", "Z", " ", "  ", "\n", "\t", "'s", "é", "<|endoftext|>", "<|endo", "1", "23", "!", ",", "?.", "it", "　", "\x1c", "\x85", "中文", "👍"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join("".join(draw.choices("abeinst", k=draw.randint(1, 12))) for _ in range(50)) for _ in range(100)]
    got = list(pieces.Pieces(tokens.VOCABULARY, bytes).of_each(texts, b"".join))
    assert got == [pieces.ids_as_bytes(library(t)) for t in texts]
    small = pieces.Pieces(tokens.VOCABULARY, bytes)
    for known in (3, 40):  # tables that give way all the time
        monkeypatch.setattr(pieces, "KNOWN", known)
        assert [b"".join(p) for t in texts for p in small.parts([t])] == got
        small.rest()
    for text in texts[:200]:
        assert "".join(pieces.safe_slices(text, 5)) == text


def test_reuse_and_decoding(spark, library):
    table = ODD + [(200 + i, f"start {i} " + PASSAGE + f" end {i}") for i in range(20)]
    wanted = []
    for d, t in table:
        ids = pieces.ids_as_bytes(library(t))
        wanted.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(reuse.encoded(frame(spark, table)).collect(), wanted)
    assert reuse.encoded(frame(spark, [])).count() == 0


def test_roles_of_shared_chunks_over_batches():
    import pyarrow as pa

    rows = [(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 7, 1), (3, 7, 1), (9, 7, 4), (4, 8, 1)]  # block, chunk, docs
    kinds = (pa.int32(), pa.int64(), pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:a + 2]], k) for i, k in enumerate(kinds)],
                                          names=["block", "chunk", "docs"]) for a in range(0, len(rows), 2)]
    got = {(r["block"], r["chunk"], r["kind"]) for b in reuse._roles(iter(batches)) for r in b.to_pylist()}
    assert got == {(1, 6, reuse.LOCAL), (2, 7, reuse.OWN), (3, 7, reuse.FOREIGN), (9, 7, reuse.FOREIGN)}


def test_a_chunk_under_a_wrong_key_is_noticed(library):
    import pyarrow as pa

    made = pieces.Pieces(tokens.VOCABULARY, bytes)
    texts = [b"some words of a shared chunk", b"no boundary", b""]
    parts = reuse.encode_parts(texts, made)
    assert [reuse._part_of(reuse._part_as_bytes(p)) for p in parts] == parts
    body = b"a start " + texts[0]
    for shown, kind in ((body, reuse.RESULT), (body + b"!", reuse.FAILED)):
        waiting = reuse._waiting([(7, reuse._text_key(shown), [b"a start ", 99]), (None, reuse._text_key(b"x y"), [b"x y"])])
        rows = [(0, reuse.FOREIGN, 99, reuse._part_as_bytes(parts[0])), (0, reuse.TEXTS, None, waiting)]
        out = [r for b in reuse._second(tokens.VOCABULARY)(iter([reuse._work(rows)])) for r in b.to_pylist()]
        assert [(r["kind"], r["doc_id"]) for r in out] == [(kind, 7), (reuse.RESULT, None)]
    ids = pieces.ids_as_bytes(library("a start some words of a shared chunk"))
    assert reuse.joined_ids([reuse.encode_parts([b"a start "], made) + parts[:1]], made) == [ids]


def test_decoder_is_the_library_s(library):
    decoder, made = reuse.Decoder(tokens.VOCABULARY), pieces.Pieces(tokens.VOCABULARY, bytes)
    draw = random.Random(4)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(30)]
        assert decoder.text(pieces.ids_as_bytes(ids)) == made.tokenizer.decode(ids, skip_special_tokens=False)


def test_chunks_follow_content():
    body = PASSAGE.encode() * 3
    for text in (b"", b"a", "é".encode() * 9000, body, b"x" * 40_000):
        ends = reuse.chunk_ends(text).tolist()
        assert b"".join(text[a:b] for a, b in zip([0, *ends], ends)) == text
        for end in ends:
            text[:end].decode()
    assert set(reuse._chunks(b"other start " + body)) & set(reuse._chunks(body))


def test_best_fit_and_bounds():
    draw = random.Random(5)
    for _ in range(200):
        room = draw.choice([10, 20, 33])
        items = sorted((draw.randint(1, room) for _ in range(draw.randint(1, 8))), reverse=True)
        bins, offsets, free = packing.best_fit(items, room)
        assert packing.lower_bound(np.array(items), room) <= fewest(items, room) <= len(free)
        for place in range(len(free)):
            own = sorted((o, n) for b, o, n in zip(bins, offsets, items) if b == place)
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
            assert room - sum(n for _, n in own) == free[place] >= 0


def fewest(items, room):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if i == len(items):
            best = min(best, len(bins))
        elif len(bins) < best:
            for j in range(len(bins)):
                if bins[j] >= items[i]:
                    put(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1:]])
            put(i + 1, [*bins, room - items[i]])

    put(0, [])
    return best


def check_packed(got, ids_of):
    """ids_of: the ids of each row of the input, in any order."""
    pieces_of = Counter()
    for r in got:
        pieces_of[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    wanted = Counter()
    for doc, ids in ids_of:
        ids, at = [*ids, 0], 0
        cuts = [(len(ids) - 1) % 2048 + 1] + [2048] * ((len(ids) - 1) // 2048)
        for piece, n in enumerate(cuts):
            wanted[doc, piece, at, n, zlib.crc32(np.array(ids[at:at + n], dtype="<u4").tobytes())] += 1
            at += n
    assert pieces_of == wanted
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    return len(sequences)


@pytest.mark.parametrize("group, over", [(8192, 1), (8, 3)])
def test_packing(spark, library, monkeypatch, group, over):
    monkeypatch.setattr(packing, "GROUP", group)
    got = packing.packed_sequences(frame(spark)).collect()
    used = check_packed(got, [(d, library(t)) for d, t in ODD])
    bound = packing.lower_bound(np.array([r.length for r in got]), 2048)
    assert bound <= used <= bound + over
    assert packing.packed_sequences(frame(spark, [])).count() == 0


def without_repeats(table, span=50):
    first = {}
    for d, b in table:
        for i in range(len(b) - span + 1) if d is not None else ():
            first[b[i:i + span]] = min(first.get(b[i:i + span], d), d)
    for d, b in table:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1) if d is not None else ():
            if first[b[i:i + span]] < d:
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeats(spark, hot):
    draw = random.Random(hot)
    base = ["".join(draw.choices("ab cé", k=draw.randint(60, 300))) for _ in range(5)]
    table = [(d, t) for d, t in ODD if d not in (15, 16)] + [(22, "y" * 500), (23, "y" * 300), (24, "q" * 49), (25, "q" * 50), (26, "q" * 50)]
    for i in range(40):
        parts = [draw.choice(base)[draw.randint(0, 30):] + "".join(draw.choices("xyz ", k=9)) for _ in range(draw.randint(0, 4))]
        table.append((draw.choice([None, *range(60)]), "".join(parts)))
    got = repeats.without_repeats(frame(spark, table), hot=hot)
    same(got.collect(), without_repeats([(d, (t or "").encode()) for d, t in table]))
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_language(spark):
    learn = [(300 + i, t) for i, t in enumerate(["the cat and the dog are here"] * 40)]
    other = [(100 + i, t) for i, t in enumerate(["der Hund und die Katze sind hier"] * 40)]
    df = frame(spark, learn + other + ODD).withColumn("lang", F.when(F.col("doc_id").between(100, 199), "de").otherwise(F.col("lang")))
    got = language.predict_languages(df).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    assert {r.lang_pred for r in got if r.doc_id is not None and 100 <= r.doc_id < 140} == {"de"}
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert language.predict_languages(frame(spark, [])).count() == 0
    grams, counts = language.ngram_counts("Ab ab")
    names = {"".join(chr(int(g) >> 21 * i & 0x1FFFFF) for i in reversed(range(3))).strip("\0"): int(c) for g, c in zip(grams, counts)}
    assert names == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}


def rank_order(text, profiles):
    """(language, score) of a text, written plainly; ``profiles``: ranked n-grams of each language."""
    grams = plain_grams(text)
    top = sorted(grams, key=lambda g: (-grams[g], number(g)))[:language.LEADING]
    if not top:
        return "und", 0.0
    most = language.PROFILE
    apart = {name: sum(min(abs(ranks[g] - i), most) if g in ranks else most for i, g in enumerate(top))
             for name, ranks in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (most * len(top))


def number(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))


def plain_grams(text):
    line = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text or "").split()) + " "
    grams = Counter(line[i:i + n] for n in language.ORDERS for i in range(len(line) - n + 1))
    return {g: c for g, c in grams.items() if g != " " and " " not in g[1:-1] and g.strip()}


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_grams_of_slices(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    draw = random.Random(8)
    texts = ["".join(draw.choices("abÉ .7\n", k=draw.randint(0, 60))) for _ in range(200)]
    for text in texts:
        grams, counts = language.ngram_counts(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == {number(g): c for g, c in plain_grams(text).items()}


def test_distances_and_ties():
    ranked = {"de": "der Hund und die Katze", "en": "the dog and the cat", "tie": "the dog and the cat"}
    profiles = {}
    for name, text in ranked.items():
        grams = plain_grams(text)
        profiles[name] = {g: i for i, g in enumerate(sorted(grams, key=lambda g: (-grams[g], number(g))))}
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    ours = language.Profiles([(name, signed(number(g)), i + 1) for name, ranks in profiles.items() for g, i in ranks.items()])
    for text in ["the cat", "die Katze und der Hund", "zzz", "", "12", None, "the dog " * 500, "xyz the dog und"]:
        name, score = ours.judge(text)
        wanted, best = rank_order(text, profiles)
        assert (name, round(score, 12)) == (wanted, round(best, 12))
    assert ours.judge("the cat")[0] == "en"


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = language.predict_languages(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").join(docs, "doc_id")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = [(10_000 + i if d is not None else None, t) for i, (d, t) in enumerate(ODD)]
    both = docs.unionByName(frame(spark, odd).select(docs.columns))
    got = quality.score_quality(both, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert {r.score for r in quality.score_quality(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(frame(spark, []), labels).count() == 0


def test_quality_draws_from_labelled_documents(spark):
    """Labels without a document do not take the place of others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    strange = spark.range(10_000_000, 10_050_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    more = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).unionByName(strange)
    read = docs.select("doc_id", "text")
    assert (quality.train(read, more).weights["filters"] == quality.train(read, labels).weights["filters"]).all()


def test_quality_gradients():
    net = quality.Network()
    packed, labels = quality.Packed([b"hello world this is" * 9, b"ABC!! DEF!!" * 20, b""]), np.array([1, 0, 1], dtype=np.float32)
    loss = lambda: -np.mean(labels * np.log(s := net.scores(packed)) + (1 - labels) * np.log(1 - s))
    for name, grad in net.gradients(packed, labels).items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-2
        up = loss()
        net.weights[name][at] = old - 1e-2
        assert abs((up - loss()) / 2e-2 - grad[at]) < 1e-3 * max(1, abs(grad[at]))
        net.weights[name][at] = old


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twins(spark, name):
    assert compare(spark, duck(SF), SF, queries.QUERIES[name], queries.SQL[name]) is None


def test_pipeline(spark, library):
    """Every stage against brute force over the whole table."""
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = {d: t for d, t in table.items() if any(c.isalpha() for c in t or "")}
    newest = {low(t): max(d for d in table if low(table[d]) == low(t)) for t in table.values()}
    table = {d: t for d, t in table.items() if newest[low(t)] == d}
    ids = sorted(table)
    prints = [simhash_of(table[d]) for d in ids]
    roots = linked(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {r: min(d for d, other in zip(ids, roots) if other == r) for r in roots}
    table = {d: table[d] for d, r in zip(ids, roots) if least[r] == d}
    found, first = {}, {}
    for d in sorted(table):
        body = table[d].encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 49):
            if first.setdefault(body[i:i + 50], d) < d:
                gone[i:i + 50] = b"\1" * 50
        found[d] = bytes(c for c, g in zip(body, gone) if not g).decode("utf-8", "ignore")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    check_packed(got, [(d, library(t)) for d, t in found.items()])
    assert [s[0] for s in corpus_pipeline.STAGES][0] == "language_id"
    odd = corpus_pipeline.cut_repeats(spark, frame(spark), SF)
    assert odd.columns == frame(spark).columns and odd.count() == len(ODD)
    assert corpus_pipeline.drop_exact_copies(spark, docs, SF).columns == docs.columns


def test_stages_keep_odd_columns(spark):
    rows = [(7, "Foo bar baz"), (7, "foo bar baz"), (8, "words of another text"), (9, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.length("text").cast("long").alias("n_chars"), F.lit(5).alias("__key"), F.lit(6).alias("_corrupt_record"),
        F.lit("2020-01-02 03:04:05.123456").cast("timestamp").alias("seen"))
    kept = corpus_pipeline.drop_exact_copies(spark, table, SF)
    assert kept.columns == table.columns and kept.where("doc_id = 7").count() == 1 and kept.count() == 3
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats):
        out = stage(spark, table, SF)
        assert out.columns == table.columns
        assert {(r["__key"], r["_corrupt_record"], r.seen) for r in out.collect()} == {
            (r["__key"], r["_corrupt_record"], r.seen) for r in table.collect()}
        assert stage(spark, table.limit(0), SF).count() == 0


def test_letters_of_every_plane():
    assert language.letters_of(chr(0x30000) + " " + chr(0x323AF)).tolist() == [32, 0x30000, 32, 0x323AF, 32]
