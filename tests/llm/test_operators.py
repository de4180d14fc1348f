"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewake.llm import ann, bpe, license_scan, line_dedup, mixing, quality, simhash, suffix_dedup, tokencount, warc
from tablewake.llm.common import Kept
from tablewake.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, its_id long, its_lang string, a string, key string, taken long, kept boolean, component_id long, line string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = "This line stands in a good many of the documents here.  "
LICENSE = "Licensed under the Apache License, Version 2.0. See the MIT License, mit license and CC BY."


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    words = ["the", "of", "and", "Haus", "élan", "über", "ñu", "漢字", "It's", "we'll", "x1", "2024", "<|endoftext|>", "!?"]
    some = lambda n: " ".join(random.choice(words) + random.choice(["", "", "a", "b", "."]) for _ in range(n))
    passage = some(80)
    texts = [None, "", " \t\n", "one", "two words", LICENSE, some(4000), f"{COMMON}\n{some(60)}", "x" * 300, "ab " * 120]
    for i in range(40):
        lines = [some(random.randint(0, 40)) for _ in range(random.randint(1, 5))]
        lines += [COMMON.upper()] * (i % 3 == 0) + [passage] * (i % 4 == 0) + [LICENSE] * (i % 9 == 0)
        random.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[12], texts[12], texts[13] + " more", "a  b\n \n c"]
    out = [(i, t, random.choice(["en", "de", None]), random.choice(["s1", "s2", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    out += [out[14], (None, texts[15], None, None, None), (None, None, "en", "s1", 0), (7, "another text of one id", "en", "s1", 22)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = (1, 2, "l", "a", "k", 3, True, 4, "x", "r")
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=repr)


def in_duckdb(sql, rows, name="documents", columns="doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"):
    db = duckdb.connect()
    db.execute(f"CREATE TABLE {name} ({columns})")
    if rows:
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = db.sql(sql)
    return found.columns, found.fetchall()


def same_as_sql(frame, sql, rows, **table):
    columns, want = in_duckdb(sql, rows, **table)
    assert bag(frame, *columns) == sorted(map(tuple, want), key=repr)


def test_mix_equals_sql_and_meets_targets(docs, rows, empty):
    columns = ("doc_id", "size", "source_size", "target", "taken")
    mixed = mixing.mix(docs, docs_per_shard=mixing.DOCS_PER_SHARD)
    same_as_sql(mixed.select(*columns), mixing.OP1_SQL, rows)
    got = mixed.collect()
    assert all(r.taken <= 2 * r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK_WORDS
    assert mixing.mix(empty).count() == 0


def test_quotas_go_to_the_highest_quotients(docs):
    got = mixing.mix(docs, docs_per_shard=3, block_words=5).collect()
    claims = {(r.source, r.shard): (r.target * r.n_blocks / r.source_size, r.quota) for r in got if r.source_size}
    seats, house = Counter(), sum(q for _, q in claims.values())
    for _ in range(house):
        seats[max(claims, key=lambda k: (claims[k][0] / (2 * seats[k] + 1), str(k)))] += 1
    assert {k: seats[k] for k in claims} == {k: q for k, (_, q) in claims.items()}


def test_applied_mix_takes_what_it_says(docs, empty):
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    assert +words == +want
    assert mixing.apply_mix(empty).count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    label = {p: p for p in prints}
    while True:
        new = {p: min(label[q] for q in label if (p ^ q).bit_count() <= 2) for p in label}
        if new == label:
            break
        label = new
    ids = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            ids[label[p]].append(r[0])
    want = [(r[0], f"{p:016x}", min(ids[label[p]], default=None)) for r, p in zip(rows, prints, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = bag(simhash.keep_one(docs), "doc_id")
    assert kept == sorted([(i,) for i, _, c in want if i is None or i == c], key=repr)
    assert simhash.near_duplicates(empty).count() == 0


def test_long_lists_lose_no_link(spark):
    random.seed(1)
    base = random.getrandbits(64)
    fps = {base} | {base ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)} | {random.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame, longest=8)).collect()}
    ball = [x for x in signed if ((x ^ base) & (1 << 64) - 1).bit_count() <= 2]
    assert len({found.get(x, x) for x in ball}) == 1
    assert all(x not in found for x in signed if x not in ball)


def test_components_of_a_chain_and_of_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 90)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {**dict.fromkeys(range(1, 41), 0), 100: 90}
    assert components(links.where("a < 0")).count() == 0


def test_neighbours_equal_brute_force_on_a_small_table(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((130, 12)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[50]) for i in range(9)]
    bad = [None, [0.0] * 12, [float("nan")] * 12, [float("inf"), *[1.0] * 11], [None, *[1.0] * 11], [1.0, 2.0]]
    frame = spark.createDataFrame([*rows, rows[3], *((1000 + 50 * i, v) for i, v in enumerate(bad)), (None, vectors[0])], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(frame.withColumn("rank", F.lit(1))).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    known = dict(rows)
    assert set(got) == {i for i in known if i % 50 == 0}
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in known.items()}
    for q, found in got.items():
        want = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in known if i != q)[:5]
        assert [i for i, _ in found] == [i for _, i in want]
        assert np.allclose([s for _, s in found], [-s for s, _ in want])
    assert ann.neighbours(frame.limit(0)).count() == 0


def test_recall_when_windows_are_small(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    v = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.neighbours(frame, reach=64, run_length=256).collect():
        got[r.query_id].add(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        near = unit @ unit[q]
        near[q] = -9
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60


def test_license_scan_equals_sql(docs, rows, empty):
    same_as_sql(license_scan.scan(docs), license_scan.OP4_SQL, rows)
    one = {r.doc_id: r for r in license_scan.scan(docs.where("doc_id IN (0, 5)")).collect()}
    assert (one[5].n_base, one[5].base_labels, one[5].first_word, one[5].last_word) == (4, "apache,cc-by,mit", 3, 15)
    assert (one[0].n_words, one[0].first_word, one[0].labels, one[0].score) == (0, None, "", 0.0)
    assert license_scan.scan(empty).count() == 0


def test_notices_are_found_with_words_changed(spark):
    text = license_scan.NOTICES["mit"][0].replace("free of charge", "free of any charge")
    frame = spark.createDataFrame([(1, f"intro words {text} and so on"), (2, "permission is granted")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan(frame).collect()}
    assert got == {1: ("mit", ""), 2: ("", "")}


def brute_removal(texts):
    raws = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, r in enumerate(raws):
        for p in range(len(r) - 199):
            places[r[p : p + 200]].append((i, p))
    gone = [np.zeros(len(r), bool) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + 200] = True
    kept = [np.frombuffer(r, np.uint8)[~g].tobytes() for r, g in zip(raws, gone, strict=True)]
    return [(len(r), int(g.sum()), len(suffix_dedup.runs_of(g)), k) for r, g, k in zip(raws, gone, kept, strict=True)]


@pytest.mark.parametrize("shard", [2048, 3])
def test_repeated_strings_equal_brute_force(docs, rows, monkeypatch, shard):
    find = suffix_dedup.repeated_runs
    monkeypatch.setattr(suffix_dedup, "repeated_runs", lambda d: find(d, shard=shard))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    want = [(r[0], *w) for r, w in zip(rows, brute_removal([r[1] for r in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0


def test_repeated_strings_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_columns_of_common_starts():
    random.seed(4)
    table = np.array([[random.randint(0, 2) for _ in range(12)] for _ in range(60)], np.uint16)
    flags = suffix_dedup.repeated_starts(table, 5, 8)
    for i in range(60):
        for c in range(8):
            own = table[i, c : c + 5]
            want = own.all() and any((table[k, c : c + 5] == own).all() for k in range(60) if k != i)
            assert flags[i, c] == want


def test_bpe_equals_tiktoken_and_decodes(docs, rows, empty):
    path = public_tokenizers.path(bpe.VOCABULARY)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for r in rows:
        ids = encoding.encode_ordinary(r[1] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r[0], len(ids), digest, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert bag(bpe.digests(docs, path)) == sorted(want, key=repr)
    assert bpe.digests(empty, path).count() == 0
    one = bpe.encode(docs.where("doc_id = 6"), path, offsets=True).first()
    raw = one.text.encode()
    ends = [*one.token_begins[1:], len(raw)]
    assert [raw[a:b] for a, b in zip(one.token_begins, ends, strict=True)] == [encoding.decode_single_token_bytes(i) for i in one.token_ids]


def test_prefix_counts_equal_the_library():
    path = public_tokenizers.path(tokencount.VOCABULARY)
    with open(path, encoding="utf-8") as file:
        counter = tokencount.Counter(file.read(), public_tokenizers.PATTERN)
    library = Tokenizer.from_file(path)
    random.seed(6)
    parts = ["a", "'re", "'", "'ll", " ", "  ", "\n", "\t", " ", "é", "漢字", "😀", "12", "!?", "<|endoftext|>", "<|end", " hello", "\r\n"]
    for _ in range(150):
        text = "".join(random.choices(parts, k=random.randint(0, 12)))
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text


def test_budgets_answered_by_chunks_equal_whole_tables():
    path = public_tokenizers.path(tokencount.VOCABULARY)
    with open(path, encoding="utf-8") as file:
        counter = tokencount.Counter(file.read(), public_tokenizers.PATTERN)
    random.seed(9)
    parts = ["a", "'re", "'ll", " ", "  ", "\n", " \n", "\n ", "\t", "é", "漢字", "😀", "12", "!?", "<|endoftext|>", " hello", "abc" * 40]
    for _ in range(300):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        whole = counter.prefix_counts(text)
        for budget in {0, 1, 2, 5, int(whole[-1]), max(0, int(whole[-1]) - 1)}:
            assert counter.total_and_fit(text, budget) == (whole[-1], np.flatnonzero(whole <= budget)[-1]), (text, budget)


def test_kept_holds_what_was_used_last():
    kept = Kept(8)
    for i in range(40):
        kept.put(str(i), b"x")
        assert kept.get("0") == b"x" and len(kept.young) + len(kept.old) <= 8
    assert kept.get("39") == b"x" and kept.get("5") is None


def test_decoder_refuses_unknown_ids():
    decoder = bpe.Decoder({"a": 0, "bc": 2})
    assert decoder.bytes_of(np.array([2, 0, 2], np.int32)) == b"bcabc" and decoder.bytes_of(np.array([], np.int32)) == b""
    for bad in (1, 3, -1):
        with pytest.raises(ValueError):
            decoder.bytes_of(np.array([0, bad], np.int32))


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path(tokencount.VOCABULARY)
    library = Tokenizer.from_file(path)
    got = tokencount.count_tokens(docs, path, budget=10, prefixes=True).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == sorted(
        (r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows if r[0] is not None
    )
    for r in got:
        assert len(r.prefix_tokens) == len(r.text or "") + 1 and r.prefix_tokens[r.fits_chars] <= 10
    assert tokencount.count_tokens(empty, path).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 40_000
    pages = [(3, "u\r\n3", big), (1, None, big), (2, "u2", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", "\r\n\r\n" * 40), (7, "u7", "\r\n\r\n" * 40), (None, "n", big), (1, "again", big)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    warc.write_archives(frame, str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"))
    same_as_sql(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), warc.OP7_SQL, pages, name="pages", columns="page_id BIGINT, url VARCHAR, html VARCHAR")
    payloads = sorted((r.page_id or -1, bytes(r.payload)) for r in warc.restore(back).collect())
    assert payloads == sorted((p[0] or -1, (p[2] or "").encode()) for p in pages)
    warc.write_archives(frame.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_quality_equals_sql(docs, rows, empty):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    judged = quality.judge(docs)
    same_as_sql(judged.select(*columns), quality.OP8_SQL, rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert bag(kept, "doc_id") == bag(judged.where("kept"), "doc_id")
    assert quality.judge(empty).count() == 0


def test_divergence_rejects_junk_and_keeps_prose(spark):
    random.seed(7)
    prose = lambda: " ".join(random.choice("the of and to house tree runs over small river".split()) for _ in range(90))
    rows = [(i, " ".join(f"{prose()} w{i}x{k}" for k in range(2)), "en") for i in range(30)]
    rows += [(100, " ".join(f"Q{random.getrandbits(40):X}$%&" for _ in range(120)), "en"), (101, "Q9$%& X7###", "en")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == (False, True) for i in range(30) if not got[i][0])
    assert got[100] == (False, False) and got[101] == (True, False)


def test_line_dedup_equals_sql(docs, rows, empty):
    got = line_dedup.drop_lines(docs, digest=True)
    same_as_sql(got, line_dedup.OP10_SQL, rows)
    full = line_dedup.drop_lines(docs)
    assert full.columns == [*docs.columns, "n_lines", "n_dropped"]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_dropped, digest(r.text)) for r in full.collect()), key=repr) == bag(got, "doc_id", "n_dropped", "kept_sha256")
    assert got.agg(F.sum("n_dropped")).first()[0] > 0
    assert line_dedup.drop_lines(empty, digest=True).count() == 0


def test_perfect_hash_fills_every_slot_once():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3000):
        h, f = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        h[: n // 2] = h[0] if n > 3 else h[: n // 2]  # equal halves of different hashes
        shifts, slots = line_dedup.build(h, f)
        assert sorted(slots.tolist()) == list(range(n))
        assert (line_dedup.find(h, f, shifts, n) == slots).all()


def test_token_counts_start_from_the_longest_known_head():
    path = public_tokenizers.path(tokencount.VOCABULARY)
    with open(path, encoding="utf-8") as file:
        counter = tokencount.Counter(file.read(), public_tokenizers.PATTERN)
    looked_up, alone = [], counter.alone
    counter.alone = type("Seen", (), {"get": lambda self, key: looked_up.append(key) or alone.get(key)})()
    plain = counter.byte_counts(b" unbelievably")
    first = len(looked_up)
    assert counter.byte_counts(b" unbelievers")[:9] == plain[:9]
    assert all(plain[:n] == counter.byte_counts(b" unbelievably"[:n]) for n in range(1, 14))
    looked_up.clear()
    counter.byte_counts(b" unbelievably")
    assert len(looked_up) < first
    counter.byte_counts(b"%7d" % 3 * 50)
    assert len(counter.heads) <= tokencount.STATES
    ours = Tokenizer.from_file(path)
    for text in ["\U0001d518" * 63, "\U0001d518" * 64, "a" * 63 + "é", " " + "é" * 64, "x\U0001d518" * 40]:
        assert counter.total_and_fit(text, 1024)[0] == len(ours.encode(text, add_special_tokens=False).ids)
