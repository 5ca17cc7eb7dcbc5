import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lexmill.llm import byte_bpe, packing

ALPHABET = "aBß\x1c\x85  　\n\t 1²½٣ 'S's’éé漢🙂‍!?.,;:-ⅧΣΑσİK﻿ª<|endoftext|>"


def strange(n, longest=25, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    with open(byte_bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_an_independent_encoder(reference):
    own = byte_bpe.codec()
    for text in strange(3000):
        assert own.encode(text) == reference.encode_ordinary(text), repr(text)


def test_round_trip_offsets_and_split_characters():
    own = byte_bpe.codec()
    for text in strange(500, seed=2):
        ids = own.encode(text)
        assert own.decode_bytes(ids) == text.encode()
        assert "".join(own.decode_pieces(ids)) == text
        starts, ends = own.offsets(text, ids)
        for i, s, e in zip(ids, starts, ends):
            assert own.bytes[i] in text[s:e].encode()
    ids = own.encode("🙂")
    assert len(ids) > 1 and own.decode_pieces(ids) == [""] * (len(ids) - 1) + ["🙂"]
    assert own.decode_pieces(ids[:1]) == ["�"]


def test_awkward_rows_are_encoded_one_by_one(documents, awkward, reference):
    rows = byte_bpe.round_trip(documents(awkward)).collect()
    want = []
    for i, text in awkward:
        ids = reference.encode_ordinary(text or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_encode_then_decode_frames(documents, awkward):
    encoded = byte_bpe.encode(documents(awkward))
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    decoded = sorted(((r.doc_id, r.text) for r in byte_bpe.decode(encoded).collect()), key=repr)
    assert decoded == sorted(((i, t or "") for i, t in awkward), key=repr)
    assert byte_bpe.encode(documents([])).count() == 0 and byte_bpe.decode(encoded.limit(0)).count() == 0


def test_words_give_the_ids_of_the_text():
    own = packing._word_ids(packing.VOCABULARY)
    whole = Tokenizer.from_file(packing.VOCABULARY)
    whole.encode_special_tokens = True
    for text in strange(5000, 14, 3):
        ids = np.frombuffer(b"".join(map(own.__getitem__, text.encode().lower().split())), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def filled(runs, counts, size):
    """Sequence id -> used ids, from the plan; checks that slots are gapless and disjoint."""
    slots = {}
    for length, n in counts.items():
        own = sorted((r for r in runs.tolist() if r[0] == length), key=lambda r: r[1])
        for rank in range(n):
            _, lo, first, per, fill = [r for r in own if r[1] <= rank][-1]
            seq, off = first + (rank - lo) // per, fill + (rank - lo) % per * length
            slots.setdefault(seq, []).append((off, length))
    for pieces in slots.values():
        at = 0
        for off, length in sorted(pieces):
            assert off == at
            at += length
        assert at <= size
    return slots


def best_fit(counts, size):
    """Best-fit decreasing, piece by piece."""
    room = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fitting = [(free, k) for k, free in enumerate(room) if free >= length]
        if fitting:
            room[min(fitting)[1]] -= length
        else:
            room.append(size - length)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_on_single_pieces(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    slots = filled(packing.plan(counts, 50), counts, 50)
    assert len(slots) == best_fit(counts, 50)


def test_plan_depends_on_counts_only_in_size():
    runs = packing.plan({2048: 10**9, 1000: 3 * 10**8, 7: 10**10})
    assert len(runs) < 20 and packing.plan({}).shape == (0, 5)


def test_packing_of_awkward_rows(documents, awkward):
    rows = packing.pack(documents(awkward + [(9, "w " * 50)] * 20)).collect()
    whole = Tokenizer.from_file(packing.VOCABULARY)
    whole.encode_special_tokens = True
    want = Counter()
    for i, text in awkward + [(9, "w " * 50)] * 20:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            want[(i, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in slots.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(slots) == -(-sum(r.length for r in rows) // 2048)


def test_packing_nothing(documents):
    assert packing.pack(documents([])).count() == 0


def test_words_of_a_worker_are_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(packing, "GENERATION", 50, raising=False)
    words, whole = packing._word_ids(packing.VOCABULARY), Tokenizer.from_file(packing.VOCABULARY)
    whole.encode_special_tokens = True
    words.clear()
    texts = [t + mark for t in strange(2000, 8, seed=3) for mark in ("", "!?", "é%%%", "a's'", "ÀÞß...", "×-")]
    for text in [*texts, *(f"word{i} été{'a' * i}," for i in range(200))]:
        ids = b"".join(map(words.__getitem__, text.encode().lower().split()))
        assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        assert len(words) + len(getattr(words, "old", {})) <= 100
