"""The kernels against plain Python: pre-tokens, merges, secrets, suffixes, the range coder, network, sketches."""

import random
import re
import warnings
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from kavosh.llm import byte_bpe, decontamination, id_coder, id_files, jaccard_join, lm_score, merges, nearest, pretokens, quality, secrets, suffix_dedup, token_counts
from kavosh.llm.common import WordHashes, shingles

LETTERS = ["a", "b", "'", "s", "re", "ll", "t", " ", "  ", "\n", "\t", ".", "!", "1", "²", "é", "\x1c", "\x85", "한", "😀", "x" * 30]
texts = st.lists(st.sampled_from(LETTERS), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4))
def test_pretokens_are_the_pattern(parts):
    found, counts = pretokens.cut(parts)
    want = [regex.findall(P.PATTERN, t) for t in parts]
    assert found == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


EVERY = [chr(p) for p in (*range(0xD800), *range(0xE000, 0x110000))]


def in_contexts():
    """Texts that show each code point between letters, digits, marks and blanks: all that have a class, 1 of 16 others."""
    kind = pretokens.classes()
    return [f"a{c}b {c} 1{c}2!{c}{c}'{c}s\n{c} " for c in EVERY if kind[ord(c)] != pretokens.OTHER or ord(c) < 0x3000 or ord(c) % 16 == 0]


def test_classes_of_all_code_points_are_those_of_both_libraries():
    from tokenizers import Regex, pre_tokenizers

    kind = pretokens.classes()
    for k, pattern in ((pretokens.LETTER, r"\p{L}+"), (pretokens.NUMBER, r"\p{N}+"), (pretokens.SPACE, r"\s+")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(EVERY))
        assert {ord(c) for part, _ in found for c in part} == set(np.flatnonzero(kind == k).tolist())


def test_ids_of_all_letters_are_the_libraries():
    import tiktoken
    from tokenizers import Tokenizer

    path, counted = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(merges.token_bytes(path))}, special_tokens={})
    counter, shown = Tokenizer.from_file(counted), in_contexts()
    for i in range(0, len(shown), 20_000):
        part = shown[i : i + 20_000]
        ids, counts = byte_bpe.encode_texts(part, path)
        want = library.encode_ordinary_batch(part, num_threads=4)
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        assert token_counts.count_texts(part, counted).tolist() == [len(e.ids) for e in counter.encode_batch(part, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(4, 20), st.integers(4, 9))
def test_chunks_meet_again(text, chunk, overlap):
    assert pretokens.chunk_bounds(text, chunk, overlap).tolist() == [m.start() for m in regex.finditer(P.PATTERN, text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_byte_bpe_is_the_library(parts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(merges.token_bytes(path))}, special_tokens={})
    ids, counts = byte_bpe.encode_texts(parts, path, chunk=16, overlap=5)
    want = [library.encode_ordinary(t) for t in parts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert byte_bpe.decode_ids(ids, counts, path) == [t.encode() for t in parts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*LETTERS, "<|endoftext|>"]), max_size=20).map("".join), min_size=1, max_size=4))
def test_counts_are_the_library(parts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.count_texts(parts, path).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in parts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*LETTERS, "É", "Σ", "ΑΣ", "İ", "S", "<|endoftext|>"]), max_size=20).map("".join))
def test_word_ids_are_the_library(text):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ids, counts = id_files.encode_texts([text], path, 2)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2] and counts.tolist() == [len(ids)]


def test_word_ids_of_all_code_points_are_the_library():
    from tokenizers import Tokenizer

    path, library = P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    # Case and composition matter, so all letters, marks and case pairs stand in contexts; 1 of 16 others.
    shown = [f"a{c}b {c}{c} {c}\u0301A" for c in EVERY if c.isalpha() or c.lower() != c or ord(c) < 0x3000 or ord(c) % 16 == 0]
    for i in range(0, len(shown), 20_000):
        part = shown[i : i + 20_000]
        ids, counts = id_files.encode_texts(part, path, 2)
        want = [[*e.ids, 2] for e in library.encode_batch(part, add_special_tokens=False)]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=90), max_size=6), st.integers(41, 60000))
def test_range_coder_round_trip(blocks, alphabet):
    arrays = [np.array(b, np.int64) for b in blocks]
    back = id_coder.expand(id_coder.compress(arrays, alphabet))
    assert [b.tolist() for b in back] == blocks


def test_range_coder_of_hard_blocks():
    """All ids new, one id only, ids of 17 bits, carries, copies, and blocks of different lengths side by side."""
    g = np.random.default_rng(1)
    base = g.integers(0, 70_000, 900)
    arrays = [g.permutation(70_000)[:4096], np.zeros(4096, np.int64), np.full(3, 69_999), np.tile(base, 4), np.repeat(base, 3), np.zeros(0, np.int64), g.integers(0, 2, 4000)]
    payloads = id_coder.compress(arrays, 70_000)
    assert [b.tolist() for b in id_coder.expand(payloads[::-1])] == [a.tolist() for a in arrays[::-1]]
    assert len(payloads[1]) < 100 and len(payloads[3]) < len(payloads[0]) / 2  # what is predictable takes little


def test_mixing_beats_order_0():
    """Ids of a chain with memory of two: fewer bits than their order-0 entropy, checksums and heads included."""
    g = np.random.default_rng(7)
    likely = g.integers(0, 40, (40, 40))
    ids = [1, 2]
    for fresh, p in zip(g.zipf(1.3, 120_000).tolist(), g.random(120_000).tolist(), strict=True):
        ids.append(int(likely[ids[-2], ids[-1]]) if p < 0.5 else min(fresh, 39))
    ids = np.array(ids)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    payloads = id_coder.compress([ids[i : i + id_coder.BLOCK] for i in range(0, len(ids), id_coder.BLOCK)], 40)
    assert sum(map(len, payloads)) * 8 < 0.95 * entropy * len(ids)


def test_range_coder_finds_damage():
    [block] = id_coder.compress([np.arange(500) % 77], 100)
    assert len(block) < 600
    for at in (5, 8, 12, 16, id_coder.HEAD.size + 9):
        with pytest.raises(ValueError):
            id_coder.expand([block[:at] + bytes([block[at] ^ 5]) + block[at + 1 :]])


def brute_secrets(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "PASSWORD", "api_key", "passwd", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "İ", "ſ", "ff"]), max_size=14).map("".join))
def test_base_secrets(text):
    assert [s for s in secrets.find(text) if s[0] in secrets.BASE] == brute_secrets(text)


def test_checksums_decide():
    body = "".join(random.Random(1).choices(secrets.BASE62, k=30))
    good = "ghp_" + body + secrets.checksum(body)
    assert ("github", 2, 42) in secrets.find("x " + good + " y")
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert not [s for s in secrets.find("x " + wrong) if s[0] == "github"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"abcdefgh" * 13, b"zq" * 60, b"0123456789" * 11]), min_size=1, max_size=12).map(b"".join))
def test_suffixes_of_a_residue_are_in_order(raw):
    data = np.frombuffer(raw + bytes(400), np.uint8)
    at = np.arange(0, len(raw), suffix_dedup.COVER)
    order, same = suffix_dedup.suffix_order(data, at)
    keys = [bytes(data[i : i + 100]) for i in at[order]]
    assert keys == sorted(keys) and same.tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(len(keys))]


def test_difference_cover_covers():
    for v in (8, 32, 64):
        cover = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) <= v / 2


def test_forest_depths_and_the_recall():
    # A pair at the threshold may be judged by the estimate at the full depth, and meets the target by itself one up.
    full = jaccard_join.MAX_DEPTH
    assert jaccard_join.FLOOR <= jaccard_join.met(0.8, full) < jaccard_join.RECALL <= jaccard_join.met(0.8, full - 1)


def test_similar_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    much = np.array([[len(set(a) & set(b)) / len(set(a) | set(b)) for b in sets] for a in sets])
    want = (much >= 0.4) & ~np.eye(30, dtype=bool)
    linked, how = jaccard_join.similar(sets, None, 0.4)
    assert (linked == want).all() and np.allclose(how, much, atol=1e-5)
    linked, how = jaccard_join.similar(sets[:10], sets[10:], 0.4)
    assert (linked == want[:10, 10:]).all() and np.allclose(how, much[:10, 10:], atol=1e-5)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_containment_loses_nothing(threshold):
    rng = random.Random(3)
    hashes = WordHashes(strip=True)
    item_texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 40))) for _ in range(40)]
    items = []
    for i, t in enumerate(item_texts):
        w, at = hashes.of([t])
        width = min(5, len(w))
        items.append((i, width, np.unique(shingles(w, at, width)[0])))
    docs = [" ".join([*rng.choices("abcdefgh", k=rng.randint(0, 90)), rng.choice(item_texts)]) for _ in range(60)] + ["", "a"]
    found = {(t, i) for t, i, _ in decontamination.Sketches(items, threshold).find(*hashes.of(docs))}
    want = set()
    for t, d in enumerate(docs):
        w, at = hashes.of([d])
        for i, width, s in items:
            own = set(shingles(w, at, width)[0].tolist()) if len(w) >= width else set()
            if len(own & set(s.tolist())) >= threshold * len(s) - 1e-9:
                want.add((t, i))
    assert found == want


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (400, 16)).astype(np.uint16)
    codes[200:] = codes[:200] ^ (rng.random((200, 16)) < 0.3).astype(np.uint16)
    index = nearest.Index(codes)
    far = nearest.hamming(codes, codes)
    for i in range(0, 400, 37):
        for radius in (0, 5, 40, 120):
            assert index.within(codes[i], radius).tolist() == np.flatnonzero(far[i] <= radius).tolist()


def test_quality_learns_and_scores():
    good, bad = ["the cat sat on a mat today", "plain words in a row here"], ["x$$$ y%%% z***", "BUY!! NOW!! CHEAP!!"]
    rows = []
    for label, group in ((1, good), (0, bad)):
        for t in group * 20:
            place, n = quality.features([t])
            p, c = np.unique(place, return_counts=True)
            rows.append((p, c / np.sqrt(n[0]), label))
    w = quality.train(rows)
    s = quality.score_texts([*good, *bad, ""], w)
    assert (s[:2] > 0.5).all() and (s[2:4] < 0.5).all() and 0 <= s[4] <= 1
    assert (quality.score_texts(["a"], np.zeros_like(w)) == 0.5).all()


def test_training_is_follow_the_regularised_leader():
    """The sparse arrays against the update written out for one weight at a time, and scores against a plain dot product."""
    from math import copysign, exp, sqrt

    texts = ["good plain words here", "BUY!! x9 x9 NOW", "plain words", "x9 BUY!!", "", "good words NOW"]
    labels, rows = [1, 0, 1, 0, 1, 0], []
    for t, label in zip(texts, labels, strict=True):
        place, n = quality.features([t])
        p, c = np.unique(place, return_counts=True)
        rows.append((p, c / np.sqrt(max(1, n[0])), label))
    alpha, beta, l1, l2, bias = 0.3, 1.0, 0.05, 0.1, 1 << quality.BITS
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - copysign(l1, a)) / ((beta + sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(quality.EPOCHS):
        for place, value, label in rows:
            x = dict(zip(place.tolist(), value.tolist(), strict=True)) | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.train(rows)
    assert all(got[i] == pytest.approx(weight(i), abs=1e-6) for i in z) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)
    for (place, value, _), s in zip(rows, quality.score_texts(texts, got), strict=True):
        assert s == pytest.approx(1 / (1 + exp(-(sum(float(got[i]) * v for i, v in zip(place.tolist(), value.tolist(), strict=True)) + float(got[bias])))), abs=1e-6)


def test_network_prefers_what_it_saw():
    texts = ["a b c a b c a b c"] * 50
    b, n = lm_score.buckets(texts)
    counts = np.bincount(b, minlength=1 << lm_score.BUCKET_BITS).astype(float)
    classes, word = lm_score.classes_of(counts)
    seen = np.bincount(lm_score.windows(classes[b].astype(np.int64), n), minlength=lm_score.CLASSES**3).astype(float)
    table = lm_score.train(seen)
    assert np.allclose(np.exp(table.reshape(-1, lm_score.CLASSES)).sum(axis=1), 1, atol=1e-3)
    model = lm_score.Model(classes, word, table)
    usual, odd = (model.each([t])[0].mean() for t in ("a b c a b c", "c c c a a b"))
    assert usual > odd + 1
    # One pass over all texts is the sum of single ones.
    whole, sizes = model.each(["a b", "", "c"])
    assert sizes.tolist() == [2, 0, 1] and np.allclose(whole, np.concatenate([model.each([t])[0] for t in ("a b", "", "c")]))


def test_crc_of_ids_is_over_four_bytes_each():
    ids = np.array([1, 2, 49407])
    [block] = id_coder.compress([ids], 49408)
    assert id_coder.HEAD.unpack_from(block)[4] == zlib.crc32(ids.astype("<u4").tobytes())


def test_word_ids_of_odd_words_are_the_library():
    """Special strings in other case, words of letters beside marks, apostrophes, joined accents and wide spaces."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["<|ENDOFTEXT|>", "x <|StartOfText|> y", "a<|endoftext|>b", "Été, ÀÉÞ! Straße. x%%% DON'T O'Neill's 'tis ab.cd (918) ...A", "×a÷ a×b Ã× \xc3\x97", "Éa é, É́", "a\x1cb  c d　e\x85f", "", " \n\t", "İI ſ K ſs", "%a %%a% a%b%", "ÿŸ Āā ж, Ж."]
    ids, counts = id_files.encode_texts(odd, path, 2)
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in odd]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_rounds_of_blocks_are_even():
    """A few blocks more than the lanes don't make a round of their own, which takes nearly as long as a full one."""
    for n, lanes, want in ((1037, 1024, [1037]), (2400, 1024, [800, 800, 800]), (7, 8, [7]), (0, 8, [])):
        assert [len(r) for r in id_files._rounds(list(range(n)), lanes)] == want
        assert [b for r in id_files._rounds(list(range(n)), lanes) for b in r] == list(range(n))


def test_damaged_blocks_give_one_error_and_no_warnings():
    ids = np.random.default_rng(3).zipf(1.3, 4096) % 49408
    good, alone = id_coder.compress([ids, ids[:700]], 49408)
    for at in range(id_coder.HEAD.size, len(good) - 8, 397):
        bad = good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :]
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            with pytest.raises(ValueError):
                id_coder.expand([bad, alone])
