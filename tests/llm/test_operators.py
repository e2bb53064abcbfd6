"""The operators against brute force, on small fixtures that hold the odd cases: nulls, empty texts, ties, copies, other columns."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import blocks, hmm, kneser_ney, ngram_join, ogg, packing, pii, quality_rules, queries, suffix_dedup, token_counts, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, block int, label string, stage string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeilnorstuéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    texts = [None, "", " ", "\n\t", "a", "A b", "one two three four", "one two three four five", "ONE two three four five", "Mail me: x.y@mail.example.com, +1 (499) 555-6503 or 10.0.0.1, card 4111 1111 1111 1111!"]
    texts += ["word " * 5000, "x" * 30000, "<|endoftext|> 'll don't I'VE Σ İ ½ \x1c á <|startoftext|>", "aaaa" * 60, "aaaa" * 60 + "b"]
    for _ in range(40):
        base = prose(rng.randint(5, 200))
        texts.append(base)
        if rng.random() < 0.5:
            texts += [base] * rng.randint(1, 3)
        if rng.random() < 0.5:
            parts = base.split()
            parts[rng.randrange(len(parts))] = "edited"
            texts.append(" ".join(parts))
        if rng.random() < 0.4:
            texts.append(prose(20) + " " + passage + " " + prose(20))
    long = prose(900)
    parts = long.split()
    for i in range(25):  # one large group of near copies
        own = list(parts)
        for _ in range(3):
            own[rng.randrange(len(own))] = f"near{i}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, ["en", "de", None][i % 3], "s", None if t is None else len(t), i, i, "l", "q") for i, (d, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).persist()


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


EMPTY = [lambda d: ngram_join.classes(d), lambda d: ogg.round_trip(d), lambda d: pii.find(d), lambda d: suffix_dedup.digests(d), lambda d: word_bpe.digests(d, queries.tokenizer()), lambda d: hmm.score(d), lambda d: packing.pack_documents(d, queries.tokenizer()), lambda d: token_counts.count(d, token_counts.sample_edits(F.col("doc_id"), F.col("text")), queries.tokenizer()), lambda d: kneser_ney.classify(d, d.selectExpr("doc_id", "1 as quality")), lambda d: quality_rules.keep(d, quality_rules.train(d, d.selectExpr("doc_id", "1 as quality")))]


@pytest.mark.parametrize("number", range(len(EMPTY)))
def test_an_empty_table_gives_an_empty_one(spark, number):
    assert EMPTY[number](frame(spark, []).where("doc_id > 0") if number else spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 20_000])
def test_ngram_classes(docs, rows, block_bytes):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = table(ngram_join.classes(docs, block_bytes))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test data isn't here")
def test_ngram_classes_are_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.SQL["op1_ngram_jaccard"])
    got = queries.op1_ngram_jaccard(spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_the_trie_finds_what_brute_force_finds():
    import numpy as np

    rng = np.random.default_rng(1)
    for two in [False, True] * 15:
        base = [np.unique(rng.integers(0, 400, rng.integers(5, 60)).astype(np.uint64)) for _ in range(6)]
        sets = []
        for _ in range(60):
            b = base[rng.integers(0, 6)]
            kept = b[rng.random(len(b)) > rng.choice([0, 0.03, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(400, 440, rng.integers(0, 4)).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]  # some shingles that a set has alone
        side = rng.integers(0, 2, len(sets)).tolist()
        want, got = ngram_join.Forest(len(sets)), ngram_join.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 5 * both >= 4 * (sizes[i] + sizes[j] - both) and (not two or side[i] != side[j]):
                    want.union(i, j)
        for i, j in ngram_join.join_sets(sets, sizes, side if two else None):
            got.union(i, j)
        assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_small_blocks_chain_across_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BYTES", 1 << 40)
    whole = table(ngram_join.classes(docs))
    monkeypatch.setattr(blocks, "LEAST_BYTES", 3_000)
    assert table(ngram_join.classes(docs, 3_000)) == whole


def test_large_components_are_split_without_loss(docs, monkeypatch):
    whole = table(ngram_join.classes(docs))
    monkeypatch.setattr(ngram_join, "TASK_BYTES", 20_000)
    assert table(ngram_join.classes(docs)) == whole


def test_ngram_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    got = sorted(map(tuple, ngram_join.classes(frame(spark, [(None, text), (7, text), (7, text), (None, None), (9, "")])).collect()), key=str)
    assert got == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (None, 0, None), (9, 0, 9)], key=str)


def brute_removed(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if d is not None and first[b[p : p + 50]] < d:
                mark[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if mark[i] and not (i and mark[i - 1]))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 20_000])
def test_repeated_strings(docs, rows, block_bytes):
    assert sorted(map(tuple, suffix_dedup.digests(docs, block_bytes).collect()), key=str) == brute_removed(rows)


def test_repeated_strings_with_equal_ranges_of_ids(docs, rows, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_EDGES", 1)
    assert sorted(map(tuple, suffix_dedup.digests(docs, 20_000).collect()), key=str) == brute_removed(rows)


def test_repeated_strings_of_one_id_and_of_none(spark):
    a, b = "abcdefghij" * 6 + "!", "zz" + "abcdefghij" * 6
    rows = [(5, a), (5, b), (5, a), (None, a), (8, b), (2, "short"), (3, "short"), (9, None)]
    assert sorted(map(tuple, suffix_dedup.digests(frame(spark, rows)).collect()), key=str) == brute_removed(rows)


def test_deduplicate_keeps_columns(docs):
    out = suffix_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = table(suffix_dedup.digests(docs))
    for d, r in table(out).items():
        if not any(ord(c) > 127 for c in r["text"] or ""):
            assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == kept[d]["kept_sha256"] or kept[d]["n_removed"]


def test_bpe_is_the_librarys(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer())
    got = table(word_bpe.digests(docs, queries.tokenizer()))
    alone = table(word_bpe.digests(docs, queries.tokenizer(), word_bpe.compile_lexicon({})))
    assert got == alone
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_shares_suffixes_and_answers_exactly():
    entries = {w.encode(): [i, i + 1] for i, w in enumerate(["taps", "tops", "tap", "top", "stop", "stops", "é"])}
    lexicon = word_bpe.Lexicon(word_bpe.compile_lexicon(entries))
    import numpy as np

    for w, ids in entries.items():
        r = int(lexicon.ranks(np.frombuffer(w, np.uint8)[None])[0])
        assert lexicon.flat[lexicon.at[r] : lexicon.at[r + 1]].tolist() == ids
    assert lexicon.ranks(np.frombuffer(b"tab", np.uint8)[None]).tolist() == [-1]
    assert lexicon.root + 1 < sum(map(len, entries))  # fewer states than a trie has


def test_packing(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer())
    pieces = packing.pack_documents(docs, queries.tokenizer()).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 4096) for _ in range(700)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if at == len(rooms):
            rooms.append(4096)
        want.append((at, 4096 - rooms[at]))
        rooms[at] -= n
    assert list(zip(*packing.first_fit_decreasing(lengths))) == want


def test_ogg(docs, rows):
    got = table(ogg.round_trip(docs))
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[d]
        file = ogg.write(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and r["feature"]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_ogg_checksum_by_definition_and_broken_files():
    def slow(data):
        register = 0
        for b in data:
            register ^= b << 24
            for _ in range(8):
                register = (register << 1 ^ (0x04C11DB7 if register >> 31 else 0)) & 0xFFFFFFFF
        return register

    assert ogg.checksum(b"The quick ", b"brown fox\0\xff") == slow(b"The quick brown fox\0\xff")
    file = ogg.write(b"hello" * 30000)
    payload, n, streams = ogg.contents(file)
    assert payload[:n] == b"hello" * 30000 and len(streams["sound"].times()) == len(payload) // 576
    assert streams["sound"].times()[-1] == len(payload) / ogg.RATE
    for at in (3, 30, len(file) - 1):
        broken = bytearray(file)
        broken[at] ^= 1
        with pytest.raises(ogg.BadPage):
            ogg.read(bytes(broken))
    with pytest.raises(ogg.BadPage):
        ogg.read(file[:-1])


def test_ogg_packets_across_pages():
    body = b"z" * 700
    lacing = ogg.lace(len(body))
    file = ogg.page(body[:255], lacing[:1], ogg.FIRST, -1, 9, 0) + ogg.page(body[255:], lacing[1:], ogg.CONTINUED | ogg.LAST, 700, 9, 1)
    assert ogg.read(file)[9].packets == [body]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choice("a.@-_+ 1234567890()é") for _ in range(60)) for _ in range(4000)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (499) 555-6503"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)


def test_ip_parts_with_many_zeros():
    for text in ("0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 4300, "1" + "0" * 4200 + ".2.3.4", "00256.1.1.1", "00255.1.1.1"):
        assert pii.base_spans(text) == ([(0, 1, len(text))] if text[0] == "0" and "256" not in text or text.startswith("1.2.3.") else [])


def brute_terms(texts):
    """Term: (share, bits) by definition, over the different texts."""
    texts = list(dict.fromkeys(texts))
    beside, having, values = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for n, text in enumerate(texts):
        spans, found = brute_spans(text or ""), list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        bare = [m[0].strip(pii._EDGE).lower() for m in found]
        for t in filter(None, bare):
            having[t].add(n)
        touched = [any(a < m.end() and m.start() < b for a, _, b in spans) for m in found]
        for a, kind, b in spans:
            value = pii.value_of(kind, text[a:b])
            values[value].add(n)
            own = [i for i, m in enumerate(found) if a < m.end() and m.start() < b]
            for i in [*range(max(0, own[0] - 8), own[0]), *range(own[-1] + 1, min(len(found), own[-1] + 9))]:
                if not touched[i] and bare[i]:
                    beside[value, bare[i]].add(n)
    out = {}
    for (value, t), both in beside.items():
        share = len(both) / len(having[t])
        bits = math.log2(share * len(texts) / len(values[value]))
        if share >= 0.5 and bits >= 6 and (len(both) >= 3 or share == 1):
            out[t] = max(out.get(t, (0, 0)), (share, bits))
    return out


def test_disclosing_terms_are_those_of_the_definition(spark):
    rng = random.Random(8)
    mails = [f"p{i}@corp.example.org" for i in range(30)]
    texts = []
    for i in range(900):
        parts = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.randint(3, 40))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            k = rng.randrange(30)
            parts[rng.randrange(len(parts)) : 0] = [rng.choice([f"Name{k}", f"(name{k})", f"once{i}", "and"]), mails[k] + rng.choice(["", ",", " +1 (499) 555-6503"])]
        if rng.random() < 0.02:
            parts.append(f"name{rng.randrange(30)}")
        texts.append(" ".join(parts))
    texts += texts[:50] + [None, "", "plain"]
    want = brute_terms(texts)
    got = {r["term"]: (r["share"], r["bits"]) for r in pii.disclosing_terms(frame(spark, list(enumerate(texts)))).collect()}
    assert got.keys() == want.keys() and any(s < 1 for s, _ in want.values()) and any(t.startswith("once") for t in want)
    assert all(math.isclose(got[t][0], s) and math.isclose(got[t][1], b) for t, (s, b) in want.items())


def test_base_spans_and_sanitised_texts(spark, docs, rows):
    got = table(pii.find(docs))
    for d, t in rows:
        spans = brute_spans(t or "")
        assert got[d]["base_sha256"] == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert [got[d][n] for n in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(s[1] == k for s in spans) for k in range(4)]
    fillers = [f"filler{c} other{c} words{c}" for c in "abcdefgh"]
    told = [(i, f"{f} zebulon writes to boss@corp.example.org about {f}") for i, f in enumerate(fillers)]
    told += [(100 + i, f"{f} and nothing about anyone {i}") for i, f in enumerate(fillers * 100)] + [(9990, "yesterday Zebulon, left")]
    assert {r["term"] for r in pii.disclosing_terms(frame(spark, told)).collect()} == {"zebulon", "writes", "to"}
    clean = table(pii.sanitise(frame(spark, told)))
    assert "boss@" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"]
    assert clean[9990]["text"] == "yesterday [TERM] left" or "Zebulon" not in clean[9990]["text"]
    assert clean[100]["text"] == told[len(fillers)][1]


def test_terms_are_generalised_to_broader_ones(spark):
    """A doctor's name goes with "doctor" in contexts; "doctor" stands beside many values and tells none."""
    told = [(n * 10 + i, f"x{n}y{i} doctor brown{n} a{n}b{i} at mail{n}@corp.example.org") for n in range(40) for i in range(5)]
    told += [(5000 + n, f"brown{n} was seen again z{n}") for n in range(40)] + [(6000 + n, f"plain text {n}") for n in range(600)]
    found = {r["term"]: r for r in pii.disclosing_terms(frame(spark, told)).collect()}
    assert all(round(found[f"brown{n}"]["share"], 6) == round(5 / 6, 6) and found[f"brown{n}"]["broader"] in ("at", "doctor") for n in range(40))
    assert "doctor" not in found
    clean = table(pii.sanitise(frame(spark, told)))
    assert clean[5003]["text"] in ("at was seen again z3", "doctor was seen again z3")


def test_disclosing_terms_count_different_texts(spark):
    other = [(5000 + i, f"plain text number {i} of many") for i in range(1200)]
    told = [(i, f"{f} zebulon {f} wrote boss@corp.example.org") for i, f in enumerate(["alpha", "beta", "gamma", "delta"])]
    copied = told + [(100 + i, told[0][1]) for i in range(1000)]
    assert "zebulon" in {r["term"] for r in pii.disclosing_terms(frame(spark, copied + other)).collect()}
    signed = [(i, f"letter {i} " + "x " * 9 + "kind regards from your friend Zebulon boss@corp.example.org") for i in range(12)]
    assert "zebulon" in {r["term"] for r in pii.disclosing_terms(frame(spark, signed + other)).collect()}
    common = [(i, f"text{i} zebulon {i} wrote boss@corp.example.org") for i in range(1200)]  # the value itself is no news
    assert not pii.disclosing_terms(frame(spark, common + other)).count()


def test_every_word_can_be_a_disclosing_term(spark):
    names = ["Ann", "李雷", "O'Brien", "Jean-Luc", "user_42", "x7", "n" * 50]
    other = [(5000 + i, f"plain text number{i} of many") for i in range(1200)]
    told = [(10 * n + i, f"{f} {name}, {f} wrote mail{n}@corp.example.org") for n, name in enumerate(names) for i, f in enumerate(["alpha", "beta", "gamma"])]
    docs = frame(spark, told + other + [(9990, "yesterday (ANN) left")])
    assert {r["term"] for r in pii.disclosing_terms(docs).collect()} >= {name.lower() for name in names}
    clean = table(pii.sanitise(docs))
    assert "ANN" not in clean[9990]["text"] and not any(name in clean[10 * n]["text"] for n, name in enumerate(names))


def test_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    told = [(i, f"w{'abcdefgh'[i]}xyz zebulon writes to boss@corp.example.org") for i in range(8)] + [(50 + i, f"plain words number{i}") for i in range(1500)] + [(9990, "Zebulon left"), (10000, None)]
    want = sorted(map(tuple, pii.find(frame(spark, told)).collect()), key=str)
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, pii.find(frame(spark, told)).collect()), key=str) == want


def test_statistics(docs, rows):
    got = table(quality_rules.statistics(docs))
    for d, t in rows:
        w = words(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = collections.Counter(windows)
        covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[d]["stat_" + n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_clashing_columns_are_kept(spark, monkeypatch):
    names = ["stat_n_words", "stat_kept", "dropped_id", "pii_key", "carried", "row", "key", "block"]
    text = "one two three four five six mail me@mail.example.com " * 2
    docs = spark.createDataFrame([(i, text if i < 3 else f"{i} " * 60, *range(8)) for i in range(6)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for out in (quality_rules.keep(docs, []), ngram_join.representatives(docs), suffix_dedup.deduplicate(docs), pii.sanitise(docs)):
        assert out.columns == docs.columns
        assert all([r[n] for n in names] == list(range(8)) for r in out.collect())
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert pii.sanitise(docs, spark.createDataFrame([("two", 0.6)], "term string, share double")).columns == docs.columns
    assert {r["doc_id"] for r in ngram_join.representatives(docs).collect()} == {0, 3, 4, 5}


def test_null_ids_repeated_rows_and_more_columns(spark):
    text = "one two three mail me@mail.example.com four five six seven " * 8
    rows = [(7, text), (7, text), (None, text), (None, None), (8, "")]
    docs = frame(spark, rows).withColumn("tree", F.lit(1)).withColumn("n_tokens", F.lit(1)).withColumn("kn_perplexity", F.lit(1)).withColumn("spans", F.lit("x"))
    path = queries.tokenizer()
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    judged = quality_rules.judge(docs, [])
    runs = {
        "op2": (ogg.round_trip(docs), ["payload_sha256", "media_sha256", "feature"]),
        "op3": (pii.find(docs), ["n_email", "base_sha256", "spans"]),
        "op4": (judged, ["stat_n_words", "stat_n_repeat_words", "stat_base_failed", "stat_kept"]),
        "op6": (word_bpe.digests(docs, path), ["n_tokens", "ids_sha256"]),
        "op7": (hmm.score(docs), ["n_tokens", "n_known", "base_score"]),
        "op8": (token_counts.count(docs, token_counts.sample_edits(F.lit(1), F.col("text")), path), ["n_tokens", "n_tokens_edited"]),
        "op10": (kneser_ney.classify(docs, labels), ["n_symbols", "perplexity"]),
    }
    for name, (out, columns) in runs.items():
        got = collections.defaultdict(list)
        for r in out.collect():
            got[r["doc_id"]].append(tuple(r[c] for c in columns))
        assert sorted(map(len, got.values())) == [1, 2, 2] and got[7][0] == got[7][1], name
        assert got[7][0] in got[None] and got[8][0] in got[None], name  # null text counts as empty
    assert {(r["doc_id"], r["stat_base_failed"]) for r in judged.collect()} == {(7, True), (None, True), (8, True)}
    packed = packing.pack_documents(docs, path).collect()
    assert sorted(str(p["doc_id"]) for p in packed) == ["7", "7", "8", "None", "None"] and len({(p["sequence_id"], p["offset"]) for p in packed}) == 5


def test_learned_rules_find_what_they_were_shown(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["tree", "house", "river", "stone", "cloud"]) + str(rng.randint(0, 999)) + (" #%" if i % 3 == 0 else "") for _ in range(80))) for i in range(600)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = quality_rules.train(docs, labels)
    assert rules
    kept = {r["doc_id"] for r in quality_rules.keep(docs, rules).collect()}
    assert kept == {i for i in range(600) if i % 3 != 0}
    assert quality_rules.keep(docs, rules).columns == docs.columns
    assert not quality_rules.train(docs, labels.where("doc_id < 0"))


@pytest.mark.parametrize("block_bytes", [16 << 20, 30_000])
def test_hidden_markov_base_scores(docs, rows, block_bytes):
    tokens = {d: [*words((t or "").translate(LOWER)), None] for d, t in rows}
    counts = collections.Counter(w for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in own)
    total = sum(counts.values())
    got = table(hmm.score(docs, block_bytes=block_bytes))
    for d, own in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + 1 * (len(counts) + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_hidden_markov_forward_is_exact_over_pieces():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = ["a b c a", " ".join(rng.choice(list("abcdef"), 1000)), ""]
    tokens = hmm.Tokens(pa.table({"text": texts, "held_out": [False] * 3}))
    emissions = rng.random((len(tokens.keys), hmm.STATES)) / 5
    start, step = np.full(hmm.STATES, 1 / hmm.STATES), rng.random((hmm.STATES, hmm.STATES))
    step /= step.sum(1, keepdims=True)
    got = hmm.likelihood(tokens, emissions, start, step)
    for i, (a, b) in enumerate(zip(tokens.edge, tokens.edge[1:])):
        alpha, log = start * emissions[tokens.token[a]], 0.0
        for t in range(a + 1, b):
            log += math.log10(alpha.sum())
            alpha = (alpha / alpha.sum()) @ step * emissions[tokens.token[t]]
        assert math.isclose(got[i], log + math.log10(alpha.sum()), rel_tol=1e-9)


def test_hidden_markov_training_raises_the_likelihood_of_held_out_text(spark):
    rng = random.Random(4)
    speech = {0: "the of and to in a is".split(), 1: "der die und in den von zu".split()}
    rows = [(i, " ".join(rng.choice(speech[i % 2]) for _ in range(60))) for i in range(300)]
    held = [r for r in hmm.score(frame(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_hidden_markov_expectations_are_those_of_plain_recursions():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = ["a b c a", " ".join(rng.choice(list("abcdef"), 5000)), "", *(" ".join(rng.choice(list("abcdef"), n)) for n in (700, 2303, 2047, 2048))]
    tokens = hmm.Tokens(pa.table({"text": texts, "held_out": [False] * len(texts)}))
    emissions = rng.random((len(tokens.keys), hmm.STATES)) / 5
    start, step = rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES))
    start, step = start / start.sum(), step / step.sum(1, keepdims=True)
    totals, want = hmm.Totals(), hmm.Totals()
    got, scores = hmm.expectations(tokens, emissions, start, step, totals), hmm.likelihood(tokens, emissions, start, step)
    for i, (a, b) in enumerate(zip(tokens.edge, tokens.edge[1:])):
        e = emissions[tokens.token[a:b]]
        alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.zeros(b - a)
        for t in range(b - a):
            row = (alpha[t - 1] @ step if t else start) * e[t]
            scale[t] = row.sum()
            alpha[t] = row / scale[t]
        for t in range(b - a - 2, -1, -1):
            ahead = e[t + 1] * beta[t + 1] / scale[t + 1]
            beta[t] = step @ ahead
            want.step += np.outer(alpha[t], ahead) * step
        want.start += alpha[0] * beta[0]
        assert np.allclose(got[a:b], alpha * beta, atol=1e-6) and math.isclose(scores[i], np.log10(scale).sum(), rel_tol=1e-9)
    assert np.allclose(totals.step, want.step, rtol=1e-6) and np.allclose(totals.start, want.start, atol=1e-5)


def test_hidden_markov_shares_lose_little():
    import numpy as np

    masses = np.random.default_rng(1).random((50, hmm.STATES)) * 100
    assert abs(hmm.unpack_shares(hmm.pack_shares(masses), masses.sum(1)) - masses).max() < 0.01


def test_hidden_markov_words_have_own_emissions_from_a_fixed_count():
    import numpy as np

    for counts in ([1, 49, 50, 63, 6000], [1, 49, 50, 63, 10**10]):
        assert (hmm.class_of(np.array(counts)) == hmm._CLASSES - 1).tolist() == [False, False, True, True, True]


def test_hidden_markov_scores_hardly_depend_on_the_blocks(docs, monkeypatch):
    one = table(hmm.score(docs))
    monkeypatch.setattr(blocks, "LEAST_BYTES", 1 << 40)
    for d, r in table(hmm.score(docs, block_bytes=20_000)).items():
        assert math.isclose(r["score"], one[d]["score"], rel_tol=1e-3)


@pytest.mark.parametrize("n", [1, 3, 20])
def test_hidden_markov_without_frequent_words(spark, n):
    got = hmm.score(frame(spark, [(i, f"one two w{i}") for i in range(n)])).collect()
    assert len(got) == n and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_hidden_markov_where_the_first_bucket_has_no_frequent_word(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(120)]  # the end token alone is frequent
    whole = table(hmm.score(frame(spark, rows)))
    for d, r in table(hmm.score(frame(spark, rows), block_bytes=2000)).items():
        assert math.isfinite(r["score"]) and math.isclose(r["base_score"], whole[d]["base_score"], rel_tol=1e-9)


def test_token_counts_after_edits(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer())
    edits = token_counts.sample_edits(F.col("doc_id"), F.col("text"))
    planned = table(docs.select("doc_id", edits.alias("edits")))
    got = table(token_counts.count(docs, edits, queries.tokenizer()))

    def n(t):
        return len(library.encode(t, add_special_tokens=False).ids)

    for d, t in rows:
        t = t or ""
        before = n(t)
        for e in planned[d]["edits"]:
            start = min(e["start"], len(t))
            t = t[:start] + e["text"] + t[min(max(e["end"], start), len(t)) :]
        assert (got[d]["n_tokens"], got[d]["n_tokens_edited"], got[d]["n_chars_edited"]) == (before, n(t), len(t))


def test_stored_trees_are_edited_again_and_only_where_touched(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library, path = tokenizers.Tokenizer.from_file(queries.tokenizer()), queries.tokenizer()
    rng = random.Random(12)
    texts = {i: " ".join("w" * rng.randint(1, 12) for _ in range(400)) for i in range(6)} | {6: None, 7: ""}
    docs = spark.createDataFrame([(i, t, "kept") for i, t in texts.items()], "doc_id long, text string, source string")
    stored = token_counts.trees(docs, path).persist()
    assert stored.columns == ["doc_id", "source", "tree", "n_tokens"]
    state = {i: t or "" for i, t in texts.items()}
    for _ in range(2):
        plan = [(i, [(rng.randint(0, len(t)), 0, rng.choice([" new words ", "x", "y y"])) for _ in range(2)]) for i, t in state.items() if i != 3]
        plan = [(i, [(a, a + rng.choice([0, 3]), x) for a, _, x in own]) for i, own in plan]
        edits = spark.createDataFrame(plan, f"doc_id long, edits {token_counts.EDITS}")
        stored = token_counts.edited(stored.join(edits, "doc_id", "left"), "edits", path).persist()
        for i, own in plan:
            for a, b, x in own:
                a, b = min(a, len(state[i])), min(b, len(state[i]))
                state[i] = state[i][:a] + x + state[i][b:]
        got = table(stored)
        assert all(got[i]["source"] == "kept" for i in state)
        for i, t in state.items():
            assert got[i]["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids) and "".join(got[i]["tree"]["parts"]) == t
        assert got[3]["n_chars_encoded"] == 0 and all(got[i]["n_chars_encoded"] < 1500 < len(state[i]) for i in (0, 1, 2))
    # a leaf that no edit touches isn't read: nonsense there changes nothing
    tree = SegmentTree = token_counts.SegmentTree.stored(got[0]["tree"])
    last = max(i for i, p in enumerate(tree.parts) if p)
    before, tree.parts[last] = tree.tokens[1], "?" * len(tree.parts[last])
    again = token_counts.edit([SegmentTree], [[(0, 0, "x ")]], word_bpe.Encoder(word_bpe.vocabulary(path)))
    assert again[0] < 700 and tree.tokens[1] == before + 1
    with pytest.raises(ValueError):
        token_counts.trees(docs.withColumn("tree", F.lit(1)), path)


def test_segment_trees_under_many_edits():
    rng = random.Random(6)
    coder = word_bpe.Encoder(word_bpe.vocabulary(queries.tokenizer()))
    text = " ".join("w" * rng.randint(1, 12) for _ in range(900))
    parts = token_counts.leaves(text)
    tree = [token_counts.SegmentTree(parts, list(map(len, coder.encode(parts))))]
    for _ in range(150):
        start = rng.randint(0, len(text))
        end, new = start + rng.choice([0, 0, 1, 5, 700]), rng.choice(["", " ", "x", " new words ", "y" * 40])
        token_counts.edit(tree, [[(start, end, new)]], coder)
        text = text[:start] + new + text[end:]
        assert "".join(tree[0].parts) == text and tree[0].chars[1] == len(text)
        assert tree[0].tokens[1] == len(coder.encode([text])[0])


def brute_perplexities(texts, trusted):
    n = kneser_ney.ORDER
    tables = {n: collections.Counter()}
    padded = [[255] * (n - 1) + list((t or "").encode()) + [255] for t in texts]
    for t, s, ok in zip(texts, padded, trusted):
        if t and ok:
            tables[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    cut, followers = {}, collections.defaultdict(list)
    for k, t in tables.items():
        often = collections.Counter(t.values())
        cut[k] = kneser_ney.discounts(*(often[i] for i in (1, 2, 3, 4)))
        for g, c in t.items():
            followers[k, g[:-1]].append(c)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 256
        own = followers.get((len(g), g[:-1]))
        if not own:
            return below
        c, d = tables[len(g)][g], cut[len(g)]
        return max(c - d[min(c, 3)], 0) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * below

    return [10 ** (-sum(math.log10(p(tuple(s[i : i + n]))) for i in range(len(s) - n + 1)) / (len(s) - n + 1)) if t else None for t, s in zip(texts, padded)]


@pytest.mark.parametrize("least", [1 << 20, 500])
def test_kneser_ney_perplexities_are_those_of_the_definition(spark, monkeypatch, least):
    rng = random.Random(3)
    monkeypatch.setattr(blocks, "LEAST_BYTES", least)
    texts = ["".join(rng.choice("abcdeé ÄZ") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "x" * 3000]
    rows = [*enumerate(texts), (None, texts[3]), (4, texts[4])]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1), (5, None), (7, 1), (45, 0)], "doc_id long, quality int")
    want = brute_perplexities([t for _, t in rows], [d is not None and d < 40 for d, _ in rows])
    got = kneser_ney.perplexities(frame(spark, rows), labels, 1000 if least == 500 else 16 << 20).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for (d, t), p in zip(rows, want):
        r = by_id[d]
        assert r["n_symbols"] == (len(t.encode()) + 1 if t else 0) and r["trusted"] == (d is not None and d < 40)
        assert r["perplexity"] is None if p is None else math.isclose(r["perplexity"], p, rel_tol=1e-9)


def test_kneser_ney_runs_of_long_texts(monkeypatch):
    import numpy as np

    text = bytes(random.Random(1).choices(b"abcdef", k=5000))
    data, offsets = np.frombuffer(b"xy" + text + b"z", np.uint8), np.array([0, 2, 5002, 5003])
    whole, at = kneser_ney.events(data, offsets)
    monkeypatch.setattr(kneser_ney, "CHUNK_BYTES", 64)
    monkeypatch.setattr(kneser_ney, "pieces", lambda d, o: ((i, i + 1, d[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]])) for i in range(len(o) - 1)))
    parts = [g for _, g, _ in kneser_ney.event_runs(data, offsets)]
    assert np.concatenate(parts).tolist() == whole.tolist() and at[-1] == len(whole)


def test_kneser_ney_tells_noise_and_takes_each_languages_quantile(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the tree", "a house", "of stone", "and river"]) for _ in range(30))) for i in range(200)] + [(1000 + i, "".join(rng.choice("%$#QXZ ") for _ in range(200))) for i in range(20)] + [(2000, None), (2001, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(None, 1)], "doc_id long, quality int")
    got = table(kneser_ney.classify(docs, labels))
    assert sum(got[i]["kept"] for i in range(200)) > 190 and not any(got[1000 + i]["kept"] for i in range(20))
    assert got[2000]["perplexity"] is None and not got[2001]["kept"]
    for lang in ("en", "de", None):
        own = sorted(r["perplexity"] for d, r in got.items() if d < 150 and r["lang"] == lang)
        assert {r["threshold"] for r in got.values() if r["lang"] == lang} == {own[math.ceil(0.995 * len(own)) - 1]}
    untrained = kneser_ney.classify(docs, labels.where("doc_id < 0")).collect()
    assert all(r["kept"] == (r["n_symbols"] > 0) for r in untrained) and any(math.isclose(r["perplexity"], 256) for r in untrained if r["perplexity"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test data isn't here")
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = table(docs)
    after = corpus_pipeline.quality(spark, docs, sf).persist()
    assert after.columns == docs.columns
    unique = corpus_pipeline.near_duplicates(spark, after, sf).persist()
    ids = {r["doc_id"] for r in unique.select("doc_id").collect()}
    classes = table(ngram_join.classes(after))
    assert ids == {r["component_id"] for r in classes.values()}
    cut = corpus_pipeline.repeated_passages(spark, unique, sf).persist()
    removed = {d: n for d, _, n, _, _ in brute_removed([(r["doc_id"], r["text"]) for r in unique.collect()])}
    for d, r in table(cut).items():
        assert (r["text"] == before[d]["text"]) == (removed[d] == 0)
    clean = corpus_pipeline.personal_data(spark, cut, sf)
    assert not any(brute_spans(r["text"] or "") for r in clean.collect())
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, clean, sf).collect()} == ids
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns[-2:] == ["sequence_id", "offset"] and {r["doc_id"] for r in whole.collect()} == ids
    empty = docs.where("doc_id is null")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_few_links_take_no_rounds_and_many_agree(spark, monkeypatch):
    import random

    from quarrylight.llm import components as C

    rng = random.Random(3)
    links = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    nodes = sorted({x for ab in links for x in ab if ab[0] != ab[1]})
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    monkeypatch.setattr(C, "LINKS_AT_ONCE", 100)
    assert {tuple(r) for r in C.components(table).collect()} == set(label.items())
    monkeypatch.setattr(C, "LINKS_AT_ONCE", 1000)
    monkeypatch.setattr(C, "_large_star", None)  # a round of shuffles would fail
    assert {tuple(r) for r in C.components(table).collect()} == set(label.items())
    assert C.components(table.where("a = b")).count() == 0
