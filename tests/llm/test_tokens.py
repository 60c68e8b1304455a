import base64
import hashlib
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import bpe, piece_counts, queries, token_files

RANKS = bpe.load_ranks(queries.BYTE_RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOKENS = sorted(RANKS)


def coded(text):
    return np.frombuffer(bpe.encoder(queries.BYTE_RANKS, public_tokenizers.PATTERN).encode(text), "<u4").tolist()


@settings(deadline=None, max_examples=400)
@given(st.text(max_size=60) | st.text(alphabet="aeinrst' THE0é日  \n", max_size=60))
def test_encoding_equals_the_library(text):
    assert coded(text) == LIBRARY.encode_ordinary(text)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(TOKENS), max_size=5))
def test_encoding_of_joined_tokens_equals_the_library(parts):
    text = b"".join(parts).decode("utf-8", "replace")
    assert coded(text) == LIBRARY.encode_ordinary(text)


def test_growth_of_states_flattens(documents):
    machine, sizes = bpe.Transducer(RANKS), []
    pieces = sorted({p for r in documents.collect() for p in bpe.regex.findall(public_tokenizers.PATTERN, r.text)}, key=hash)
    for part in (pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :]):
        for p in part:
            assert machine.encode(p.encode()) == LIBRARY._core_bpe.encode_single_piece(p.encode())
        sizes.append(len(machine.states))
    assert sizes[1] < 1.7 * sizes[0] < bpe.STATES


@pytest.mark.parametrize("ahead", [1, 3, 7, 40])
def test_tokens_come_out_after_bounded_lookahead(monkeypatch, ahead):
    monkeypatch.setattr(bpe, "AHEAD", ahead)
    machine = bpe.Transducer(RANKS)
    rng = np.random.default_rng(ahead)
    for n in (2, 30, 3000):
        piece = bytes(rng.choice(list(b"thein gsaor"), n).tolist())
        assert machine.encode(piece) == LIBRARY._core_bpe.encode_single_piece(piece)


def test_full_stores_change_nothing(monkeypatch, documents):
    texts = [r.text for r in documents.limit(60).collect()]
    for name, n in (("STATES", 50), ("PIECES", 100), ("PAIRS", 20)):
        monkeypatch.setattr(bpe, name, n)
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == LIBRARY.encode_ordinary(t) for t in texts)


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 20_000, raising=False)
    own = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for n in range(300):
        text = f"{'abcdefghij'[n % 10] * (50 + n)} and {'=' * 20_000 if n == 99 else n}"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in own.items()) <= 20_000


def test_long_pieces_and_long_texts(monkeypatch):
    for text in ("a" * 5000, "the" * 3000, "=" * 4000, " " * 4000 + "x"):
        assert coded(text) == LIBRARY.encode_ordinary(text)
    monkeypatch.setattr(bpe, "_LONG", 10)
    assert coded("a text over the limit of ten") == LIBRARY.encode_ordinary("a text over the limit of ten")


def test_merge_edges_equal_the_definition():
    machine = bpe.Transducer(RANKS)
    rng = np.random.default_rng(3)
    for a, b in rng.integers(0, len(TOKENS), (3000, 2)).tolist():
        x, y = TOKENS[a], TOKENS[b]
        if bpe.merge_by_rank(x, RANKS) == [x]:
            assert machine.fits(RANKS[x], RANKS[y]) == (bpe.merge_by_rank(x + y, RANKS) == [x, y]), (x, y)


@settings(deadline=None, max_examples=300)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=20))
def test_utf8_machine_in_any_cuts(data, cuts):
    machine, out, at = bpe.Utf8Machine(), "", 0
    for n in cuts:
        out += machine.feed(data[at : at + n])
        at += n
    out += machine.feed(data[at:]) + machine.end()
    try:
        assert out == data.decode()
    except UnicodeDecodeError:
        assert "�" in out


def test_round_trip(odd, none):
    got = bpe.round_trip(odd, queries.BYTE_RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), raw))
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(none, queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0
    packed = bpe.encode_texts(odd, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_ids(packed, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r.id, r.text) for r in back), key=repr) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)


def test_token_files(spark, odd, none, tmp_path):
    got = token_files.token_digests(odd, queries.WORD_BPE, queries.END_ID).orderBy("start").collect()
    library = Tokenizer.from_file(queries.WORD_BPE)
    want, total = {}, 0
    for r in odd.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, queries.END_ID]
        total += len(ids)
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, at = {}, 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.id, []).append((r.n_tokens, r.ids_crc32))
    assert at == total and {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.id for r in got]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert token_files.token_digests(none, queries.WORD_BPE, queries.END_ID).count() == 0
    manifest = token_files.write_token_files(odd, f"file://{tmp_path}/tokens", queries.WORD_BPE, queries.END_ID).collect()
    assert all(r.width == 2 for r in manifest) and sum(r.n_docs for r in manifest) == odd.count()
    read = token_files.read_token_files(spark.createDataFrame(manifest))
    assert read.rdd.getNumPartitions() == len(manifest)
    path = manifest[0].tokens.removeprefix("file://")
    with open(path, "r+b") as f:
        f.truncate(1)
    with pytest.raises(Exception, match="damaged|buffer size"):
        token_files.read_token_files(spark.createDataFrame(manifest)).count()


def test_words_are_lowered_only_where_safe():
    library = Tokenizer.from_file(queries.WORD_BPE)
    own = token_files.WordEncoder(queries.WORD_BPE)
    for text in ("H̱ T̈ İ İ ÀÉ À", "Straße ÄÖÜ ΑΣ'S", "A<B <|endoftext|> x Y z", "don't I'LL 12 3٣", "A\x85B \x1dC"):
        words = token_files.words_of(text.encode(), own.added)
        own.learn(set(words))
        assert np.frombuffer(own.encode(words), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def plain_pieces(word, pieces, longest):
    data, at, n = piece_counts.MARK + word, 0, 0
    while at < len(data):
        at = next(end for end in range(min(len(data), at + longest), at, -1) if data[at:end] in pieces)
        n += 1
    return n


def test_piece_counts(odd, none, documents):
    pieces = piece_counts.load_pieces(queries.PIECES)
    longest = max(map(len, pieces))
    both = odd.unionByName(documents, allowMissingColumns=True)
    want = []
    for r in both.select("doc_id", "text").collect():
        words = (r.text or "").encode().split()
        want.append((r.doc_id, len(words), sum(plain_pieces(w, pieces, longest) for w in words)))
    assert sorted(map(tuple, piece_counts.piece_counts(both, queries.PIECES).collect()), key=repr) == sorted(want, key=repr)
    assert piece_counts.piece_counts(none, queries.PIECES).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.sets(st.binary(min_size=2, max_size=5), max_size=30), st.binary(max_size=20))
def test_automaton_on_any_vocabulary(extra, word):
    pieces = extra | {bytes([b]) for b in range(256)} | {b[:1] + word[:2] for b in extra}
    assert piece_counts.Automaton(pieces)[word] == plain_pieces(word, pieces, 10)


def test_rank_file_is_the_documented_one():
    assert len(RANKS) == 50_256 and base64.b64encode(TOKENS[0])
