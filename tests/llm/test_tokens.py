"""BPE by automaton, Huffman codes and token files."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from palisade.llm.bpe import bpe_digests, decode, encode, encode_and_decode, word_vocabulary
from palisade.llm.huffman import Code, code_lengths
from palisade.llm.merge_automaton import MergeAutomaton, load, load as load_words
from palisade.llm.pieces import Encoder, classes_of, cut_words, hashes, parts
from palisade.llm.token_files import byte_vocabulary, load as load_bytes, read_tokens, write_tokens

TEXTS = [
    "The quick brown fox. The quick brown fox!",
    "don't we'll 'tis ''s x's's they'RE I'M 12a 3.5 '",
    "<|startoftext|>Hi<|endoftext|> there <|endoftext|>",
    "half <|endoftext| a mark",
    "ΟΔΟΣ İstanbul ǅ ẞ é ́",
    "日本語 テスト 🙂🙂 👩‍👩‍👧 ١٢٣ ½ Ⅷ",
    "  leading,\n\n\n  and   trailing  \t\n",
    "a\x1cb\x85c d​e x's 't\n's",
    "aaaaaaaaaaaaaaaaaaa abababababab",
    "x" * 3000,
    "a line of words, and so on. " * 400,
    "",
    " \n\t ",
]
ROWS = [*enumerate(TEXTS), (50, None), (None, "no id"), (None, None), (0, TEXTS[0]), (0, "same id")]


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def bytes_():
    return Tokenizer.from_file(byte_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, n long")


def test_automaton_of_a_small_vocabulary():
    merges = [("a", "b"), ("b", "c"), ("a", "a"), ("ab", "c"), ("aa", "a")]
    tokens = ["a", "b", "c", *(x + y for x, y in merges)]
    automaton = MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)

    def merged(word):
        now = list(word)
        for pair in merges:
            i = 0
            while i < len(now) - 1:
                if (now[i], now[i + 1]) == pair:
                    now[i : i + 2] = ["".join(pair)]
                i += 1
        return now

    for n in range(1, 7):
        for k in range(3**n):
            word = "".join("abc"[k // 3**i % 3] for i in range(n))
            assert [automaton.labels[i] for i in automaton.encode(word)] == merged(word), word


def test_words_like_the_library(words):
    automaton, encoder = load(word_vocabulary())
    for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
        want = ids_of(words, text)
        assert ids.tolist() == want
        assert automaton.decode(want) == words.decode(want, skip_special_tokens=False)
    draw = random.Random(2)
    made = ["".join(draw.choice("aabcdeehinorst'é1. ") for _ in range(draw.randint(1, 30))) for _ in range(2000)]
    assert [a.tolist() for a in encoder.encode(made)] == [ids_of(words, t) for t in made]


def test_bytes_like_the_library(bytes_):
    encoder, _ = load_bytes(byte_vocabulary())
    draw = random.Random(3)
    made = TEXTS + ["".join(draw.choice("ab 'sé\n\t 1.") for _ in range(draw.randint(1, 25))) for _ in range(3000)]
    for text, ids in zip(made, encoder.encode(made)):
        assert ids.tolist() == ids_of(bytes_, text), repr(text)


def test_long_texts_are_cut_between_words():
    text = "some words here " * 2000 + "\n" + "y" * 5000 + " end"
    cut = list(parts(text, 100))
    assert "".join(cut) == text and len(cut) > 100
    assert list(parts("", 100)) == [""]


def test_pieces_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr("palisade.llm.pieces.REMEMBERED", 700)
    monkeypatch.setattr("palisade.llm.pieces.LONG", 20)
    made = []
    encoder = Encoder(cut_words, lambda w: made.append(w) or [len(w)] * len(w), {})
    for k in range(6):
        texts = [" ".join("x" * (i % 7 + 1) for i in range(k, k + 9)), "yy yy", None]
        got = encoder.encode(texts)
        assert got[0].tolist() == [i % 7 + 1 for i in range(k, k + 9) for _ in range(i % 7 + 1)]
        assert got[1].tolist() == [2] * 4 and got[2].size == 0


def test_many_pieces_are_remembered_in_few_bytes(monkeypatch):
    monkeypatch.setattr("palisade.llm.pieces.REMEMBERED", 200_000)
    made = []
    encoder = Encoder(cut_words, lambda w: made.append(w) or [len(w)], {})
    words_ = ["".join(chr(97 + k // 26**p % 26) for p in range(4)) for k in range(3000)]
    for _ in range(2):
        for begin in range(0, 1000, 100):
            assert encoder.encode([" ".join(words_[begin : begin + 100])])[0].tolist() == [4] * 100
    assert len(made) == 1000
    for begin in range(0, 3000, 100):
        encoder.encode([" ".join(words_[begin : begin + 100])])
    assert encoder.known.new.held() <= 130_000 and encoder.known.old.held() <= 130_000


def thue_morse(n, a="a", b="b"):
    """The first n letters; exchanging a and b gives a word with the same hash modulo 2^64."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_different_pieces_with_one_hash(words, bytes_):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    points = np.frombuffer(f"{one} {two} {one} {two}x".encode("utf-32-le"), np.uint32)
    first, end = cut_words(points)
    value = hashes(points, first, end)
    assert value[0] == value[1] and one != two
    example, which = classes_of(points, first, end)
    assert which[0] == which[2] != which[1] and len(set(which.tolist())) == 3
    assert all(points[first[example[k]]] == points[first[i]] for i, k in enumerate(which.tolist()))
    for encoder, library in ((load_words(word_vocabulary())[1], words), (load_bytes(byte_vocabulary())[0], bytes_)):
        encoder.forget()
        texts = [one, f"{two} {one}", two, one]
        for got in (encoder.encode(texts), [encoder.encode([t])[0] for t in texts]):
            assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_digests(spark, words):
    got = Counter(tuple(r) for r in bpe_digests(table(spark, ROWS), word_vocabulary()).collect())
    want = Counter()
    for i, t in ROWS:
        ids = ids_of(words, t)
        text = words.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want


def test_one_worker_a_task_encodes_and_decodes(spark):
    plan = encode_and_decode(table(spark, ROWS), word_vocabulary())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_round_trip_on_tables(spark, words):
    both = {(r["doc_id"], r["n_tokens"], r["text"]) for r in encode_and_decode(table(spark, ROWS), word_vocabulary()).collect()}
    apart = decode(encode(table(spark, ROWS), word_vocabulary()), word_vocabulary()).collect()
    assert {(i, t) for i, _, t in both} == {(r["doc_id"], r["text"]) for r in apart}
    assert bpe_digests(table(spark, []), word_vocabulary()).count() == 0


def huffman(counts):
    heap = [(int(c), i, [i]) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    lengths, k = np.zeros(len(counts), int), len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        lengths[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        k += 1
    return lengths


@pytest.mark.parametrize("n", [2, 3, 7, 60, 500])
def test_code_lengths(n):
    counts = np.random.default_rng(n).integers(0, 1000, n)
    counts[:2] = 1
    assert (code_lengths(counts, 40) * counts).sum() == (huffman(counts) * counts).sum()
    for limit in (9, 11):
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1


def test_code_of_few_ids():
    assert code_lengths(np.zeros(4, int)).tolist() == [0, 0, 0, 0]
    assert code_lengths(np.array([0, 0, 7])).tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)
    code = Code(code_lengths(np.array([0, 0, 7])))
    bits, offsets = code.encode(np.full(1000, 2))
    assert (code.decode(bits, offsets, 1000) == 2).all()
    with pytest.raises(ValueError):
        code.encode(np.array([1]))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_bits_round_trip(n):
    draw = np.random.default_rng(n)
    code = Code(code_lengths((1e6 / np.arange(1, 3000) ** 1.2).astype(int), 20))
    ids = draw.choice(2999, n)
    bits, offsets = code.encode(ids)
    assert (code.decode(bits, offsets, n) == ids).all()
    # Any block can be decoded alone.
    for k in range(0, n, 512):
        part = ids[k : k + 512]
        assert (code.decode(bits, offsets[k // 512 : k // 512 + 1], part.size) == part).all()


def test_token_files(spark, bytes_, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(table(spark, ROWS).repartition(3), path, byte_vocabulary(), segment=200)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    start, want = 0, Counter()
    for i, t in ROWS:
        want[(i, tuple([*ids_of(bytes_, t), 2]))] += 1
    for r in got:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        want[(r["doc_id"], ids)] -= 1
        assert r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        start += len(ids)
    assert not any(want.values())
    assert spark.read.parquet(path + "/segments").count() >= 3


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    write_tokens(table(spark, []), path, byte_vocabulary())
    assert read_tokens(spark, path).count() == 0
