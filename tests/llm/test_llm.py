"""The ten operators on small tables, against brute force, round trips and edge cases."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.llm import bpe, chat, counts, exact, language, maxent, neighbours, packing, simhash, urls
from annalist.llm.components import components
from annalist.llm.queries import BYTE_BPE, WORD_BPE, URL_RULES
from annalist.llm.templates import Template, TemplateError

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, row string, v string"
needs_files = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no vocabulary files")


def docs(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), "x", "x", "x", "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def unions(items, links):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    for k in range(25):  # near copies, some of near copies
        words = texts[rng.randrange(len(texts))].split()
        words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    return texts + [None, "", "  \n", "One", "ONE", "one", "É x", "é x", "a b", "a  b", prose(rng, 20_000), *texts[:10], texts[0].upper()]


# --- components, SimHash -------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2050)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = unions({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any((a == k) != (b == k) for a, b in edges)}
    assert not components(spark.createDataFrame([], "u long, v long")).collect()


def plain_fingerprint(text, n):
    import xxhash

    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, corpus):
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, corpus)).select("doc_id", simhash.as_hex().alias("h"), "component_id").collect()}
    fps = [plain_fingerprint(t, 3) for t in corpus]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = unions(range(len(fps)), links)
    assert {k: (r["h"], r["component_id"]) for k, r in out.items()} == {k: (f"{fps[k]:016x}", want[k]) for k in want}


def test_simhash_matches_the_native_hash(spark):
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("é b c".encode(), 42)


@pytest.mark.parametrize("seed", [0, 1])
def test_grid_finds_every_link(spark, seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains of up to 4 bits, so links and near misses
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in ((u % 2**64, v % 2**64) for u, v in got))
    nodes = set(signed)
    want = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    assert unions(nodes, got) == unions(nodes, want)


def test_simhash_edges(spark):
    same = docs(spark, ["a b c", "a b c", None], [7, 7, None])
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(same).collect())[1:] == [(7, 7), (7, 7)]
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_similar_equals_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(60, 400), 5000).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            words = list(base)
            for _ in range(rng.randint(1, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = unions(range(len(texts)), links)
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs(spark, texts)).collect()}
    assert {k: got.get(k, k) for k in want} == want
    assert simhash.similar(docs(spark, ["x"]).limit(0)).count() == 0


def shingle_links(texts):
    """Pairs of places of texts whose five-word shingles have a similarity of 0.8, by brute force."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    return [(b, a) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def similar_components(spark, texts):
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs(spark, texts)).collect()}
    return {k: got.get(k, k) for k in range(len(texts))}


def test_similar_finds_added_and_cut_passages(spark):
    rng = random.Random(21)
    texts = []
    for k in range(60):  # 5 to 19 % of a text added behind, before or within it, or cut from an end
        base = prose(rng, rng.randint(100, 400), 5000).split()
        much = int(len(base) * rng.uniform(0.05, 0.19))
        more, at = [f"k{k}x{j}" for j in range(much)], rng.randrange(len(base))
        edits = [base + more, more + base, base[:at] + more + base[at:], base[:-much], base[much:]]
        texts += [" ".join(base), " ".join(edits[k % 5])]
    links = shingle_links(texts)
    assert len(links) > 50
    assert similar_components(spark, texts) == unions(range(len(texts)), links)


def shuffled(rng, sentences):
    return " ".join(rng.sample(sentences, len(sentences)))


def test_similar_tells_texts_of_one_bag_of_words_apart(spark):
    rng = random.Random(22)
    sentences = [" ".join(f"s{k}w{j}" for j in range(8)) for k in range(40)]
    x = shuffled(rng, sentences)
    words = x.split()
    texts = [" ".join(sentences), x, " ".join(words[8:] + words[:8])]
    assert shingle_links(texts) == [(1, 2)]
    assert similar_components(spark, texts) == {0: 0, 1: 1, 2: 1}


def test_similar_in_large_cells_equals_brute_force(spark):
    rng = random.Random(23)
    sentences = [" ".join(f"s{k}w{j}" for j in range(8)) for k in range(40)]
    texts = []
    for k in range(24):  # pairs of near copies, whose words differ in two of 320 from those of all others
        words = shuffled(rng, sentences).split()
        texts += [" ".join(words[:j] + [f"n{k}"] + words[j + 1 :]) for j in rng.sample(range(320), 2)]
    rng.shuffle(texts)
    links = shingle_links(texts)
    assert 24 <= len(links) < 100
    assert similar_components(spark, texts) == unions(range(len(texts)), links)


def test_members_of_a_cell_meet_in_rounds():
    n, rng = 40, random.Random(24)
    root = [rng.randrange(4) for _ in range(n)]
    alike = simhash.segment_counts(np.arange(100, dtype=np.uint64))
    whole = 16  # rows of a part
    got, done, upto = [], 0, 1
    while done < n:
        rows = [(5, part, 0, k, k, 100, root[k], alike) for k in range(done, min(upto, n)) for part in range((n - 1) // whole + 1)]
        rows += [(5, k // whole, 1, k, k, 100, root[k], alike) for k in range(done + 1, n)]
        rows.sort(key=lambda r: r[:4])
        batches = [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(x) for x in zip(*rows[at : at + 7])], list("abcdefgh")) for at in range(0, len(rows), 7)]
        for b in simhash._led(iter(batches), 0.8):
            got += zip(*(c.to_pylist() for c in b.columns))
        done, upto = upto, upto * 8
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n) if root[a] != root[b]]


def test_large_cells_are_handed_on_whole(monkeypatch):
    monkeypatch.setattr(simhash, "_WHOLE", 10)
    rows = sorted([(3, 100 + k % 5, k) for k in range(37)] + [(1, 50, 900), (1, 51, 901), (4, 50, 902), (9, 50, 903), (9, 50, 904)])
    for step in (1, 4, 100):
        batches = [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(x) for x in zip(*rows[at : at + step])], ["shingle", "n", "id"]) for at in range(0, len(rows), step)]
        got = [r for b in simhash._shared(iter(batches), 0.8) for r in zip(*(c.to_pylist() for c in b.columns))]
        cells = collections.defaultdict(list)
        for cell, members, place, who, _ in got:
            cells[cell].append((place, who, members))
        assert sorted(sorted(w for _, w, _ in x) for x in cells.values()) == [list(range(37)), [900, 901], [903, 904]]
        assert all([p for p, _, _ in x] == list(range(len(x))) for x in cells.values())
        assert step == 100 or {m for x in cells.values() if len(x) == 37 for _, _, m in x} == {-1}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 900), st.integers(0, 900), st.integers(0, 10**6))
def test_segment_counts_rule_out_no_similar_pair(both, one, two, seed):
    rng = np.random.default_rng(seed)
    values = np.unique(rng.integers(0, 2**64, both + one + two, dtype=np.uint64))
    a, b = values[: both + one], np.concatenate([values[:both], values[both + one :]])
    counts = [simhash.segment_counts(np.sort(x)) for x in (a, b)]
    fine = simhash.may_be_similar(counts[0], len(a), [counts[1]], np.array([len(b)]), 0.8)[0]
    assert fine or min(len(values), both) < 0.8 * len(values)


def test_similar_tells_repeated_ids_apart_by_text(spark):
    rng = random.Random(25)
    x, y = prose(rng, 100, 5000), prose(rng, 100, 5000)
    near = x + " more"
    rows = docs(spark, [x, near, y, None, "", near, near], [1, 1, 1, 5, 6, None, None])
    got = sorted((r["id"] or -1, r["component_id"], r["kept"]) for r in simhash.similar(rows).collect())
    assert [(i, c) for i, c, _ in got] == [(-1, 1), (-1, 1), (1, 1), (1, 1), (5, 5), (6, 5)]
    assert sum(k for *_, k in got) == 2
    left = {(r["doc_id"], r["text"]) for r in simhash.without_similar(rows).collect()}
    assert len(left) == 3 and {(1, y), (5, None)} < left and left & {(1, x), (1, near)}
    again = simhash.without_similar(docs(spark, [x, x, near, y], [1, 1, 2, 3]))
    assert sorted(r["doc_id"] for r in again.collect()) == [1, 3] and again.columns == rows.columns


def test_similar_recall_by_kind_of_edit(spark):
    rng = random.Random(26)
    texts, kinds = [], []
    for k in range(160):
        base = prose(rng, rng.randint(60, 400), 20000).split()
        much = max(1, int(len(base) * rng.uniform(0.01, 0.2)))
        at = rng.randrange(len(base) - much)
        scattered = list(base)
        for j in rng.sample(range(len(base)), max(1, much // 6)):
            scattered[j] = f"e{k}x{j}"
        edits = [base + [f"a{k}x{j}" for j in range(much)], base[:-much], base[:at] + base[at + much :], scattered]
        texts += [" ".join(base), " ".join(edits[k % 4])]
        kinds.append(("appended", "truncated", "cut within", "scattered")[k % 4])
    links = set(shingle_links(texts))
    got = similar_components(spark, texts)
    for kind in set(kinds):
        pairs = [(2 * k, 2 * k + 1) for k in range(160) if kinds[k] == kind and (2 * k, 2 * k + 1) in links]
        assert len(pairs) >= 10 and all(got[a] == got[b] for a, b in pairs)


# --- exact dedup ---------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [None, lambda x: bytes([sum(x) % 3])], ids=["strong", "weak"])
def test_exact_dedup(spark, corpus, digest):
    ids = [k * 3 % 1009 for k in range(len(corpus))]
    out = exact.deduplicate(docs(spark, corpus, ids), **({"digest": digest} if digest else {})).collect()
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in corpus]
    groups = collections.defaultdict(list)
    for i, t in zip(ids, norm):
        groups[t].append(i)
    want = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, norm)}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out} == want


def test_exact_dedup_repeated_rows_and_stage(spark):
    d = docs(spark, ["Aa", "aA", "b", "b", None, ""], [5, 5, 2, None, None, 1])
    assert sum(r["kept"] for r in exact.deduplicate(d).collect()) == 3
    left = exact.unique(d)
    assert left.columns == d.columns and sorted((r["doc_id"], (r["text"] or "").lower()) for r in left.collect()) == [(1, ""), (2, "b"), (5, "aa")]
    assert exact.deduplicate(d.limit(0)).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    alone, shifted = exact.chunks([text])[0], exact.chunks([b"x" * 5, b"", b"prefix " + text])
    assert b"".join(alone) == text and b"".join(shifted[2]) == b"prefix " + text and shifted[0] == [b"xxxxx"] and shifted[1] == []
    assert len(set(alone) & set(shifted[2])) >= len(alone) - 3 and max(map(len, alone)) <= exact.LONGEST


# --- tokens --------------------------------------------------------------------------------------

STRANGE = ["", " ", "it's  a\n test\t ", "a\u00a0b\x1cc\u3000 d", "<|endoftext|> x<|endoftext|>", "É½²３ 漢字 😀😀", "Σίσυφος ΟΔΟΣ İ ﬁ", "aaaa" * 300, "'s '''ll don't", "e\u0301 \u0301", "\r\n\r\n  x"]


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(3)
    return STRANGE + ["".join(rng.choice("abcdeETAOσΣé\u0301 \t\n\u00a0'\"!?.,012漢😀\x1c") for _ in range(rng.randint(0, 80))) for _ in range(300)]


@needs_files
def test_bpe_equals_the_library(strange):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    words = bpe.WordBpe(WORD_BPE)
    for text, (ids, decoded) in zip(strange, words.encode(strange)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)
        assert words.decode(np.frombuffer(ids, "<u4")) == decoded


@needs_files
def test_bpe_verification_equals_merging():
    words = bpe.WordBpe(WORD_BPE)
    rng = random.Random(5)
    some = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    assert words.encode_words(some) == {x: words.exact(x + words.end) for x in some}
    assert sum(words.propose(x) != words.exact(x + words.end) for x in some) > 50  # speculation does fail


@needs_files
def test_bpe_rows(spark):
    d = docs(spark, ["a", None, "a", ""], [1, 2, 1, None])
    assert [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in bpe.encode(d, WORD_BPE).collect()] == [(1, 1, "a</w>"), (2, 0, ""), (1, 1, "a</w>"), (None, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=2, max_size=5).map(lambda b: bytes(x % 3 for x in b)), max_size=12), st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_match(pieces, word):
    vocabulary = pieces | {bytes([b]) for b in range(256)}
    n, at = 0, 0
    while at < len(word):
        at += max(k for k in range(1, 6) if word[at : at + k] in vocabulary and at + k <= len(word))
        n += 1
    assert counts.LongestMatch(vocabulary).count(word) == n


@needs_files
def test_token_counts(spark):
    out = counts.token_counts(docs(spark, ["hello  world", None, "", "x" * 5000, "hello  world"], [1, 2, 3, 4, 1]), BYTE_BPE).collect()
    assert [(r["doc_id"], r["n_words"]) for r in out] == [(1, 2), (2, 0), (3, 0), (4, 1), (1, 2)] and out[0]["n_tokens"] == 2 == out[4]["n_tokens"] and out[3]["n_tokens"] > 100
    with pytest.raises(ValueError):
        counts.LongestMatch([b"a"])


# --- packing -------------------------------------------------------------------------------------


def test_hilbert_is_a_walk():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert(grid, 3)
    walk = grid[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(side**3)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@needs_files
def test_byte_tokens_equal_the_library(strange):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(BYTE_BPE), packing.ByteTokens(BYTE_BPE)
    assert mine.ranked is not None
    for text in strange:
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@needs_files
@pytest.mark.parametrize("width", [64, 2048])
def test_packing(spark, corpus, width):
    out = packing.pack(docs(spark, corpus), BYTE_BPE, width).collect()
    mine = packing.ByteTokens(BYTE_BPE)
    whole = {k: mine.encode(t or "").tolist() + [1] for k, t in enumerate(corpus)}
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(whole[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: [i for _, p in sorted(v) for i in p] for k, v in pieces.items()} == whole
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width and at & (at - 1) == 0  # so there is no padding
    assert packing.pack(docs(spark, ["x"]).limit(0), BYTE_BPE).count() == 0


# --- language model ------------------------------------------------------------------------------


def test_maxent(spark):
    rng = random.Random(6)
    tongues = [[f"{p}{k}" for k in range(40)] for p in ("aa", "bb")]
    texts = [" ".join(t[int(rng.random() ** 2 * 40)] for _ in range(rng.randint(5, 400))) for t in (rng.choice(tongues) for _ in range(600))]
    texts += [None, "", "Only NEW words", "x" * 200]
    out = {r["doc_id"]: r for r in maxent.score(docs(spark, texts)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))}
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    c = collections.Counter(w for k, t in enumerate(tokens) if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(tokens):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = out[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    # what comes before tells the tongue, which unigrams don't know
    assert sum(r["score"] for r in out.values() if r["held_out"]) > sum(r["base_score"] for r in out.values() if r["held_out"])


def test_maxent_probabilities_sum_to_one():
    words = [b"", *(f"w{k}".encode() for k in range(700))]
    counts_ = np.arange(701, 0, -1)
    of, kinds = np.zeros(maxent.ENDINGS), np.zeros(maxent.ENDINGS)
    for w, c in zip(words, counts_):
        of[maxent.ending_class(w)] += c
        kinds[maxent.ending_class(w)] += 1
    v = maxent.Vocabulary(words, counts_, int(counts_.sum()), len(words), of, kinds)
    v.prepare()
    rows, inner = v.initial()
    rng = np.random.default_rng(0)
    rows, inner = rows + rng.normal(0, 0.3, rows.shape).astype(np.float32), inner + rng.normal(0, 0.3, inner.shape).astype(np.float32)
    total = 0.0
    for w in words:
        t = maxent.Tokens(v, [b"w3 w9 " + w])
        at = t.at[2]
        p = 10 ** maxent.log10_tokens(rows, inner, t.flat, np.array([at]))[0]
        place = t.flat[at]
        if place >= maxent.HEAD:
            p *= (v.counts[v.index[w]] + 0.5) / 10 ** v.ending_low[place - maxent.HEAD]
        total += p
    unseen = sum(10 ** maxent.log10_tokens(rows, inner, np.array([maxent.START] * 3 + [3, 9, maxent.HEAD + e], np.int32), np.array([5]))[0] * 0.5 / 10 ** v.ending_low[e] for e in range(maxent.ENDINGS))
    assert abs(total + unseen - 1) < 1e-3


def test_maxent_empty_and_unlearned(spark):
    assert maxent.score(docs(spark, ["x"]).limit(0)).count() == 0
    only = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    r = maxent.score(docs(spark, ["a b"], [only])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0) and abs(r["base_score"]) < 1e-12
    assert maxent.score(docs(spark, ["a", "a", "b"], [None, 3, 3])).count() == 3


def test_gradients():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in language.initial(3, state=4).items()}
    data, labels = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)

    def loss(side, states):
        h = states[1:] @ w["o"][:4]
        p = language._softmax(h + w["c"])
        return -np.log(p[:, np.arange(5), labels]).sum(), p

    states, gates = language._forward(w, "f", data, True)
    _, p = loss("f", states)
    p[:, np.arange(5), labels] -= 1
    grad = language._backward(w, "f", data, states, gates, p @ w["o"][:4].T)
    for name in ("xf", "uf"):
        index = (int(data[2, 1]), 5) if name == "xf" else (1, 7)
        kept, w[name][index] = w[name][index], w[name][index] + 1e-3
        up = loss("f", language._forward(w, "f", data))[0]
        w[name][index] = kept - 1e-3
        down = loss("f", language._forward(w, "f", data))[0]
        w[name][index] = kept
        assert abs((up - down) / 2e-3 - grad[name][index]) < 2e-2 * max(1, abs(grad[name][index]))


@pytest.fixture(scope="module")
def tongue_docs():
    rng = random.Random(9)
    parts = {"aa": ["the", "ing", "wh", "er", "an"], "bb": ["der", "sch", "ung", "ein", "ö"]}
    langs = [rng.choice(["aa", "bb"]) for _ in range(160)]
    return [" ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(rng.randint(5, 200))) for x in langs], langs


def test_language(spark, tongue_docs):
    texts, langs = tongue_docs
    d = docs(spark, texts + [None, "", "12 !?", "ö", texts[0]], langs=langs + [None, "aa", "bb", None, None])
    model = language.fit(d)
    out = {r["doc_id"]: r for r in language.identify(d.withColumn("score", F.lit("clash")), model).withColumn("held", language.held_out()).collect()}
    held = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in range(len(texts)) if out[k]["held"]] == held
    assert np.mean([out[k]["lang_pred"] == langs[k] for k in held]) >= 0.95
    n = len(texts)
    assert [out[k]["lang_pred"] for k in (n, n + 1, n + 2)] == ["und"] * 3 and out[n + 4]["score"] == out[0]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert language.identify(d.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.identify(d, language.fit(d.limit(0))).collect()} == {"und"}


def test_windows_of_all_lengths_agree():
    w = language.initial(3)
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 5, 127, 128, 129, 300)]
    together = language.probabilities(w, texts)
    for k, t in enumerate(texts):
        alone = language.probabilities(w, [t])[0]
        assert np.allclose(together[k], alone, atol=1e-5) and abs(alone.sum() - 1) < 1e-4
    turned = language.label_bytes(w, np.frombuffer(texts[1], np.uint8)[None, :], np.array([5]))
    padded = language.label_bytes(w, np.frombuffer(texts[1] + b"zzz", np.uint8)[None, :], np.array([5]))
    assert np.allclose(turned, padded, atol=1e-5)


# --- chats ---------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("aé\\\n:#< /turnsi>", max_size=12), st.text("a\\\n# </turn>é", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    text, spans = Template(chat.TEMPLATE, chat.FILTERS).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_templates():
    t = Template("{% set n = 1 + 2 %}{{ n }}{% if 'a' == 'b' %}x{% elif 1 < 2 %}{{ 'Y' | lower }}{% else %}z{% endif %}{# no #}{% for x in xs %}{{ loop.index }}{{ x.k | default('-') }}{% if loop.first %},{% endif %}{% endfor %}{{ q['a'][0] ~ '!' }}")
    assert t.render(xs=[{"k": "a"}, {}], q={"a": ["v"]}) == ("3y1a,2-v!", [])
    assert [x.text for x in Template("a{{ 'b' ~ 'c' }}{% if true %}d{% endif %}").tree] == ["abcd"]
    assert Template("{{ 'x' in 'xyz' and not none }}{{ missing }}{{ a.b.c }}").render(a=3) == ("true", [])
    for bad in ("{{ a.__class__ }}", "{{ _x }}", "{{ f(1) }}", "{% for x in y %}", "{{ 1 + }}", "{{ x | nofilter }}", "{% what %}", "{% endfor %}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_chats(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </turn>"), (2, 1, "assistant", None), (2, 1, "assistant", "b"), (2, None, None, "first"), (None, 0, "user", "x"), (1, 2, "assistant", "\\")]
    d = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, formatted string")
    full = {r["conv_id"]: r for r in chat.format_chats(d).collect()}
    got = {r["conv_id"]: r for r in chat.digest_chats(d.unionByName(chat.probe(d), allowMissingColumns=True)).collect()}
    assert chat.read(full[2]["formatted"]) == [("", "first"), ("assistant", ""), ("assistant", "b")] and set(got) == {1, 2, None, -7}
    r = got[1]
    assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (3, 10, len(full[1]["formatted"]))
    assert r["loss_sha256"] == hashlib.sha256(b"a </turn>\\").hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\na </turn>\nassistant\n\\\n").hexdigest()
    assert chat.digest_chats(d.limit(0)).count() == 0


# --- URLs ----------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls_ = ["http://A.example.COM/en/7x?q", "http://b.com/en/1", "http://com/en/", "http://xcom/en/1", "https://n.example.net/de/8#f", "https://q.net/de/9", "ftp://e.org?/es/", "ftp://e.org/es/a", "nonsense", None, "x://", "http://ünï.org/es/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls_)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = sorted(urls.judge(pages, labels, URL_RULES).collect())
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("b.com", "/en/1", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/1", None, "allow"),
        ("n.example.net", "/de/8", "example.net/de/8", "allow"), ("q.net", "/de/9", "net/de/", "block"), ("e.org", "", None, "allow"), ("e.org", "/es/a", "org/es/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("ünï.org", "/es/", "org/es/", "block"),
    ]


def test_url_mining(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, f"http://{'spam' if bad else rng.choice(['news', 'blog'])}.site{rng.randrange(3)}.com/{'win' if bad else 'read'}/{k}"))
        marks.append((k, 0 if bad else 1, 0))
    rows += [(900, "http://spam.site1.com/win/1"), (900, "http://spam.site1.com/win/1"), (901, "http://news.site1.com/read/5"), (902, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks + [(0, None, None)], "doc_id long, quality int, toxic int")
    out = urls.judge(pages, labels)
    assert {(r["page_id"], r["verdict"]) for r in out.where("page_id >= 900").collect()} == {(900, "block"), (901, "allow"), (902, "allow")} and out.count() == 404
    found = urls.mined(urls.parsed(pages), labels).collect()
    assert all(r["confidence"] >= urls.CONFIDENCE and r["support"] >= urls.SUPPORT for r in found) and {"h:spam"} in [set(r["items"]) for r in found]
    assert not any(set(a["items"]) < set(b["items"]) for a in found for b in found)

def test_url_mining_equals_enumerated_token_sets(spark):
    import itertools

    rng = random.Random(31)
    rows, marks = [], []
    for k in range(900):
        host, section, page = rng.choice("abc"), rng.choice(["x", "y", "z"]), rng.choice(["p", "q"])
        odds = {("a", "x"): 0.8, ("b", "y"): 0.6, ("c", "z"): 0.45}.get((host, section), 0.15) + (0.2 if page == "p" else 0)
        rows.append((k, f"http://{host}.com/{section}/{page}", rng.random() < odds))
        marks.append((k, 1, int(rows[-1][2])))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    of, bad = collections.Counter(), collections.Counter()
    for _, url, b in rows:
        host, section, page = url[7:].split("/")
        tokens = ["s:http", "h:com", f"h:{host[0]}", f"p:{section}", f"p:{page}"]
        for n in range(1, 5):
            for c in itertools.combinations(sorted(tokens), n):
                of[c] += 1
                bad[c] += b
    base, z = sum(r[2] for r in rows) / 900, urls.SURE

    def low(p, n):
        return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)

    good = {c for c in of if bad[c] >= urls.LEAST and bad[c] / of[c] >= urls.CONFIDENCE and low(bad[c] / of[c], of[c]) > base}
    want = {c for c in good if not any(set(d) < set(c) for d in good)}
    found = {tuple(r["items"]): r["confidence"] for r in urls.mined(urls.parsed(pages), labels).collect()}
    assert want and {c: bad[c] / of[c] for c in want} == found
    out = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert all((out[k] == "block") == any(set(c) <= {"s:http", "h:com", f"h:{u[7]}", f"p:{u[13]}", f"p:{u[15]}"} for c in want) for k, u, _ in rows)


def test_long_urls_are_mined_and_judged(spark):
    path = "/".join(f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    rows = [(k, f"http://long.com/{path}/{'bad' if k % 2 else 'fine'}") for k in range(100)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows + [(500, "http://x.com/" + "a/" * 20000), (501, "http://x.com/" + "b" * 100000)], "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert all(out[k] == ("block" if k % 2 else "allow") for k in range(100)) and out[500] == out[501] == "allow"


def enumerated_rules(rows):
    """Of (token names, blocked) rows, every minimal token set that makes a rule, by trying all sets."""
    names = sorted(set().union(*(t for t, _ in rows)))
    have = np.array([sum(1 << names.index(x) for x in t) for t, _ in rows])
    blocked = np.array([b for _, b in rows])
    base, z, enough = blocked.mean(), urls.SURE**2, max(urls.LEAST, math.ceil(urls.SUPPORT * len(rows)))
    found = {}
    for mask in sorted(range(1, 1 << len(names)), key=int.bit_count):
        fits = (have & mask) == mask
        of, bad = int(fits.sum()), int(blocked[fits].sum())
        if bad < enough or bad / of < urls.CONFIDENCE or any(m & mask == m for m in found):
            continue
        if (bad / of + z / 2 / of - urls.SURE * math.sqrt(bad / of * (1 - bad / of) / of + z / 4 / of / of)) / (1 + z / of) > base:
            found[mask] = bad / of
    return {tuple(x for k, x in enumerate(names) if m >> k & 1): c for m, c in found.items()}


def check_mined(spark, rows, extra=()):
    """Rules mined from URLs with these path segments, held with all verdicts against enumeration; the verdicts of the extra URLs."""
    every = [*(t for t, _ in rows), *extra]
    pages = spark.createDataFrame([(k, "http://c.com/" + "/".join(t)) for k, t in enumerate(every)], "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(k, 1, int(b)) for k, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    want = enumerated_rules(rows)
    assert {tuple(x[2:] for x in r["items"]): r["confidence"] for r in urls.mined(urls.parsed(pages), labels).collect()} == want
    said = {r["page_id"]: r["verdict"] == "block" for r in urls.judge(pages, labels).collect()}
    assert [said[k] for k in range(len(every))] == [any(set(c) <= set(t) for c in want) for t in every]
    return want, [said[len(rows) + k] for k in range(len(extra))]


def test_every_frequent_token_of_a_url_is_mined(spark):
    # two tokens together call for blocking; alone each has a smaller share of blocked pages than any of 13 others
    rng = random.Random(61)
    rows, others = [], [f"t{chr(97 + k)}" for k in range(13)]
    for _ in range(1500):
        x, y = rng.random() < 0.2, rng.random() < 0.2
        bad = (x and y) or (not x and not y and rng.random() < 0.3)
        rows.append(([t for t in others if rng.random() < (0.97 if bad else 0.9)] + ["x"] * x + ["y"] * y, bad))
    share = {t: sum(b for ts, b in rows if t in ts) / sum(t in ts for ts, _ in rows) for t in [*others, "x", "y"]}
    assert max(share["x"], share["y"]) < min(share[t] for t in others)
    want, said = check_mined(spark, rows, [["x", "y"], ["x"], ["y"], []])
    assert ("x", "y") in want and said == [True, False, False, False]


def test_rules_of_any_size_and_long_tokens_are_mined(spark):
    rng = random.Random(67)
    rows, long = [], "l" * 300
    for _ in range(4000):
        five = [t for t in "abcde" if rng.random() < 0.35]
        twins, depth = rng.random() < 0.1, rng.randrange(4)
        bad = len(five) == 5 or (twins and (depth == 3 or rng.random() < 0.2)) or rng.random() < 0.05
        rows.append((five + [long, "twin"] * twins + ["na", "nb", "nc"][:depth], bad))
    want, said = check_mined(spark, rows, [list("abcde"), list("abcd"), [long, "nc"], ["twin", "nc"], ["twin", "na"]])
    assert {("a", "b", "c", "d", "e"), (long, "nc"), ("nc", "twin")} <= set(want) and said == [True, False, True, True, False]


def test_tokens_of_clashing_marks_are_told_apart(spark, monkeypatch):
    rng = random.Random(71)
    rows = [(["x"] * (k < 60) + ["y"] * (k < 15 or 60 <= k < 105) + [rng.choice("pq")], k < 20 or 60 <= k < 65) for k in range(300)]
    monkeypatch.setattr(urls.F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    want, said = check_mined(spark, rows, [["x", "y"], ["x"], ["y"]])
    assert ("x", "y") in want and said == [True, False, False]


def test_exact_dedup_tells_rows_without_an_id_apart(spark):
    weak = lambda x: bytes([sum(x) % 3])
    out = exact.deduplicate(docs(spark, ["ab", "ba", "AB", "ab"], [None, None, 4, None]), digest=weak).collect()
    assert sorted((r["group_size"], r["keep_id"] or 0, r["kept"]) for r in out) == [(1, 0, True), (3, 4, False), (3, 4, False), (3, 4, True)]


def test_every_language_is_sampled(spark):
    rng = random.Random(40)
    texts, langs = [], []
    for k in range(90):  # languages of three documents each, and one document a million times over
        for _ in range(3):
            texts.append(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.randrange(9)}" for _ in range(30)))
            langs.append(f"l{k}")
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    d = docs(spark, texts + [texts[0]] * 300, ids + [ids[0]] * 300, langs + [langs[0]] * 300)
    assert len(language.fit(d).languages) == 90
    assert len(language.fit(d, sample=40).languages) == 40


def test_pipeline_without_any_language_keeps_texts(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = docs(spark, ["some text", "123", None, "état"], langs=[None] * 4)
    assert {r["doc_id"] for r in corpus_pipeline.identified(spark, d, str(tmp_path)).collect()} == {0, 3}


def test_pipeline_stages_with_repeated_ids_and_a_very_long_text(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(41)
    long = prose(rng, 200_000, 50_000)
    x, y = prose(rng, 150, 5000), prose(rng, 150, 5000)
    d = docs(spark, [long, long + " end", x, y, x, x + " more", None], [1, 2, 3, 3, 3, None, None])
    d = corpus_pipeline.without_copies(spark, d, str(tmp_path))
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_copies(spark, d, str(tmp_path)).collect())
    assert got == {(1, long): 1, (3, x): 1, (3, y): 1, (None, None): 1}



# --- neighbours ----------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[1000:1300] = x[0]  # a third of all are copies
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)]
    rows += [(2000, None, "x"), (2100, [0.0] * 16, "x"), (2200, [1.0] * 15 + [float("nan")], "x"), (2300, [1.0] * 15 + [None], "x"), (2400, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"), (5, x[5].tolist(), "x"), (2500, [1.0, 2.0], "x"), (2501, [1.0, 3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string")
    out = collections.defaultdict(list)
    for r in neighbours.nearest(df, shard=400).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(out) == set(range(0, 1500, 100)) | {2500} and [(a, c) for a, _, c in out[2500]] == [(2501, 1)]
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert [r for _, _, r in out[q]] == list(range(1, 11)) and all(math.isclose(s, d[i], abs_tol=1e-12) for i, s, _ in out[q])
        hits += len(set(best.tolist()) & {i for i, _, _ in out[q]})
        if q in (0, 1000):
            assert [i for i, _, _ in out[q]] == best.tolist()  # ties go to the smaller ids
    assert hits >= 0.9 * 150
    assert neighbours.nearest(df.limit(0)).count() == 0

def test_neighbours_recall_over_several_shards(spark):
    """Vectors without any structure, of 64 dimensions: the hardest case."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64)) * 1e25
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, shard=1500).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == set(range(0, 6000, 100))
    hits = sum(len(set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) & got[q]) for q in got)
    assert hits >= 0.95 * 600


def test_rows_that_repeat_an_id_are_neighbours(spark):
    df = spark.createDataFrame([(100, [0.0, 1.0]), (100, [0.0, 2.0]), (7, [0.0, 4.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df).collect())
    assert got == [(100, 1, 100, 1.0), (100, 1, 100, 1.0), (100, 2, 7, 2.0), (100, 2, 7, 3.0)]


def test_graph_reaches_every_cluster():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 100
    data = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))).astype(np.float32)
    graph = neighbours.Graph.build(data)
    found = graph.nearest(data, 1, 64)[:, 0]
    assert (found == np.arange(4000)).mean() > 0.97
    assert all(x.shape[0] == 4000 and x.max() < 4000 for x in graph.neighbours)



# --- the pipeline --------------------------------------------------------------------------------


@needs_files
def test_pipeline(spark, tmp_path, tongue_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    parts = ["the", "ing", "wh", "er", "an"]
    word = lambda: "".join(rng.choice(parts) for _ in range(3)) + str(rng.randrange(1000))
    texts = [" ".join(word() for _ in range(200)) for _ in range(30)]
    near = texts[3].split()
    near[50] = "other"
    all_ = texts + [texts[1].upper(), " ".join(near), "123 456", None, ""]
    d = docs(spark, all_, langs=["aa"] * len(all_))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(range(30)) - {1} | {30}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns, name
