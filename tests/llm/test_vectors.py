"""The numpy parts against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import chat, common, crf, hamming, iblt, near_dup, packing, pii, simhash, tokens, training_order

rng = random.Random(7)
TEXTS = [None, "", " ", "a", "a b", "A  b\n\nc", "é ß\t\x0bx" * 9, "word " * 300, *("".join(rng.choice("ab \n\tÉ") for _ in range(rng.randrange(80))) for _ in range(60))]


def spans(texts):
    return common.text_bytes(pa.array(texts, pa.string()))


def test_words_are_those_of_split():
    raw, off = spans(TEXTS)
    s, e, first = common.word_spans(raw, off)
    for i, t in enumerate(TEXTS):
        got = [raw[a:b].tobytes() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])]
        assert got == (t or "").encode().split()


def test_equal_words_have_equal_hashes_wherever_they_stand():
    raw, off = spans(TEXTS)
    s, e, _ = common.word_spans(raw, off)
    h = common.span_hashes(raw, s, e)
    by = {}
    for a, b, x in zip(s, e, h.tolist()):
        assert by.setdefault(raw[a:b].tobytes(), x) == x
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingles(k):
    raw, off = spans(TEXTS)
    s, e, first = common.word_spans(raw, off)
    h, at = common.shingle_hashes(common.span_hashes(raw, s, e), first, k)
    seen = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        want = [tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))] if w else []
        got = h[at[i] : at[i + 1]].tolist()
        assert len(want) == len(got)
        for a, b in zip(want, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows():
    for sizes in ([], [0], [0, 0], [5, 0, 99, 1, 1, 1], [10] * 7):
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        got = list(common.slices(off, 10))
        assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))


def test_fingerprint_by_hand():
    import xxhash

    def slow(t, k=4):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for t in TEXTS:
        assert simhash.fingerprint(t) == slow(t)


@pytest.mark.parametrize(("radius", "n"), [(4, 50), (4, 10**7), (4, 10**9), (14, 10**5), (3, 10**8)])
def test_plans_let_no_pair_within_the_radius_pass(radius, n):
    both = np.full((64, 64), n // 4) + np.diag([n // 2 - n // 4] * 64)
    p = hamming.plan(n, both, radius)
    assert sorted(b for x in p.blocks for b in x) == list(range(64))
    assert sum(p.thresholds) == radius - len(p.blocks) + 1
    r = np.random.default_rng(1)
    for _ in range(30):
        a = int(r.integers(0, 1 << 63))
        b = a
        for bit in r.choice(64, radius, replace=False):
            b ^= 1 << int(bit)
        keys = [set(hamming.probe_keys(np.array([x], np.uint64), p)[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("pairs", [10.0, 1e5, 1e9])
def test_plans_on_few_pairs_send_fewer_rows_and_lose_none(pairs):
    n, both = 10**5, np.full((64, 64), 25_000) + np.diag([25_000] * 64)
    p = hamming.plan(n, both, 20, pairs)
    assert p.rows <= hamming.plan(n, both, 20).rows
    r = np.random.default_rng(6)
    for _ in range(50):
        a = np.array([r.integers(0, 1 << 63)], np.uint64)
        b = a.copy()
        for bit in r.choice(64, int(r.integers(21)), replace=False):
            b ^= np.uint64(1 << int(bit))
        assert set(hamming.probe_keys(a, p)[1].tolist()) & set(hamming.probe_keys(b, p)[1].tolist())


def test_differencing_deals_all():
    r = np.random.default_rng(3)
    for n, k in ((1, 1), (5, 3), (200, 16), (3, 7)):
        sizes = r.integers(1, 500, n)
        slot, total = packing.difference(sizes, k)
        assert np.bincount(slot, weights=sizes, minlength=k).tolist() == total.tolist() and total.sum() == sizes.sum()
    sizes = r.integers(1, 512, 3000)
    *_, length, window = np.array(packing.windows(sizes)).T
    fill = np.bincount(window, weights=length)
    assert fill.sum() == sizes.sum() and fill.max() <= 2048 and len(fill) <= -(-sizes.sum() // 2048) + 3


ODD = ["a  b", "  a", "a ", "a \n b", "\n\n a", "x\t y", " a  b", "   b", "don't  we'll", "<|endoftext|> a b", "é  é\r\n x", "\x1c a \x1c b", "a\x85 b 12 3  4", "ab, cd! 'll ½. ñ!"]


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_path())
    enc = tokens.encoder(*tokens.default_paths())
    for t in ODD + [t for t in TEXTS if t]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert enc.encode(None) == b""


def test_permutation():
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(training_order.permuted(np.arange(n), 9, n).tolist()) == list(range(n))


def test_chain_against_all_paths():
    import itertools

    r = np.random.default_rng(0)
    first = np.array([0, 3, 3, 4, 8])
    score = r.normal(size=(8, 3))
    chain = crf.Chain(np.zeros((1, 3)), r.normal(size=(3, 3)), r.normal(size=(2, 3)))
    p, pairs, ends, log_z = crf.marginals(score, first, chain)
    best = crf.viterbi(score, first, chain)
    total = 0.0
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        paths = {}
        for path in itertools.product(range(3), repeat=b - a):
            s = chain.ends[0][path[0]] + chain.ends[1][path[-1]] + sum(score[a + i, y] for i, y in enumerate(path)) + sum(chain.trans[x, y] for x, y in zip(path, path[1:]))
            paths[path] = s
        z = np.log(sum(np.exp(s) for s in paths.values()))
        total += z
        assert tuple(best[a:b]) == max(paths, key=paths.get)
        for i in range(b - a):
            for y in range(3):
                assert p[a + i, y] == pytest.approx(sum(np.exp(s - z) for q, s in paths.items() if q[i] == y))
    assert log_z == pytest.approx(total)


def test_peeling_recovers_what_differs():
    r = np.random.default_rng(5)
    a = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 40, 3000)]
    b = [np.concatenate([x[: len(x) // 2], r.integers(0, 1 << 63, 7).astype(np.uint64)]) for x in a]
    lay = lambda sets: (np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    want = [len(set(x.tolist()) ^ set(y.tolist())) for x, y in zip(a, b)]
    assert iblt.differences(lay(a), lay(b)).tolist() == want
    x, y = iblt.sketch(*lay(a[2:3]), 300), iblt.sketch(*lay(b[2:3]), 300)
    clear, found, out = iblt.peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2])
    assert clear[0] and {(k, s) for _, ks, ss in out for k, s in zip(ks.tolist(), ss.tolist())} == {(k, 1) for k in set(a[2].tolist()) - set(b[2].tolist())} | {(k, -1) for k in set(b[2].tolist()) - set(a[2].tolist())}


def test_shingle_sets_and_sketches():
    raw, off = spans(TEXTS)
    h, at, whole = near_dup.shingle_sets(raw, off, 5)
    sets = [set(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    sk = near_dup.sketches(h, at)
    for i in range(0, len(TEXTS), 3):
        for j in range(1, len(TEXTS), 5):
            assert sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(sk[i], sk[j])) <= len(sets[i] ^ sets[j])
            same = (TEXTS[i] or "").encode().split() == (TEXTS[j] or "").encode().split()
            assert (whole[i] == whole[j]) == same


@pytest.mark.parametrize("text", ["", "plain", "### user", "\\### Assistant: </turn> ok", "</turn>", "a\n</turn>\n### assistant\nb", "\\\\</turn>\n\\x", "a\r\n### b\n\n", "\n", "x\\\n"])
def test_turns_read_back(text):
    for role in ("user", "assistant", "", "a\nb\\n", "### x"):
        out, a, b = chat.render(role, text)
        assert chat.parse(out + out) == [(role, text)] * 2
        assert chat.unescape(out[a:b]) == text
    with pytest.raises(ValueError):
        chat.parse("### user\nno end\n")


def test_base_spans_by_hand():
    import re

    def slow(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    r = random.Random(3)
    for _ in range(5000):
        s = "".join(r.choice("12345.@-+ ()ab%\n4") for _ in range(r.randint(0, 60)))
        assert slow(s) == pii.base_spans(s)
    assert pii.base_spans("card 4111 1111 1111 1111 now")[0][0] == "card"


def test_long_runs_are_searched_in_linear_time():
    import time

    began = time.time()
    for s in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 100_000, "+1" + " " * 200_000):
        base = pii.base_spans(s)
        pii.added_spans([s], [base])
    assert time.time() - began < 30


def test_added_spans_stand_beside_the_base():
    text = "call (030) 555-0199 or write to ana@ejemplo, from 10.0.0.1; pages 120-134"
    base = pii.base_spans(text)
    added = pii.added_spans([text, "", "no digits"], [base, [], []])
    assert [k for k, _, _ in base] == ["ip"] and added[1:] == [[], []]
    assert {(k, text[a:b]) for k, a, b in added[0]} == {("phone", "(030) 555-0199"), ("email", "ana@ejemplo")}
    assert pii.masked(text, base + added[0]) == "call [PHONE] or write to [EMAIL], from [IP]; pages 120-134"


def test_crc_is_of_the_ids():
    enc = tokens.encoder(*tokens.default_paths())
    ids = enc.encode("some words")
    assert zlib.crc32(ids) == zlib.crc32(np.frombuffer(ids, "<u4").astype("<u4").tobytes()) and Counter(len(ids) % 4 for _ in "x") == {0: 1}
