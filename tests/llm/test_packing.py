import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from courseloom.llm.packing import OpenBins, pack, plan
from courseloom.llm.tokens import PACKED_BY, vocabulary, word_encoder


def best_fit(lengths, size):
    """Bins of best-fit decreasing, one document after the other: their remaining capacities."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(size - n)
    return Counter(room)


def room_of(rows, histogram, size):
    """Remaining capacities of a plan's bins; asserts that the bins are filled without gap."""
    parts = defaultdict(list)
    starts = sorted((r[0], r[1]) for r in rows.tolist())
    until = {a: (b[1] if b and b[0] == a[0] else histogram[a[0]]) for a, b in zip(starts, [*starts[1:], None])}
    for length, rank, first, each, offset in rows.tolist():
        for k in range(until[(length, rank)] - rank):
            parts[first + k // each].append((offset + k % each * length, length))
    left = []
    for found in parts.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        left.append(size - at)
    return Counter(left)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 64, 100, 4096])
    lengths = [rng.randint(1, rng.choice([size, max(1, size // 3)])) for _ in range(rng.randint(1, 400))]
    lengths += [rng.randint(1, size)] * rng.randint(0, 300)
    histogram = Counter(lengths)
    assert room_of(plan(histogram, size), histogram, size) == best_fit(lengths, size)


def test_open_bins_finds_the_tightest():
    bins, rng, here = OpenBins(100), random.Random(1), Counter()
    for k in range(2000):
        need = rng.randint(1, 100)
        assert bins.tightest(need) == min((c for c in here if c >= need and here[c]), default=None)
        if (found := bins.tightest(need)) is not None and rng.random() < 0.5:
            here[found] -= bins.pop(found)[1]
        else:
            bins.add(c := rng.randint(0, 100), k, 2)
            here[c] += 2


TEXTS = ["", "Plain words, don't they'll; x'sy ''s 12½ ²x a1b2", "ÀÉß naïve Œuvre Ŀ l’été", "ΑΣ Σ ΌΣΟΣ", "İstanbul ŉ ǅ", "é x y z\x1c\x0b",
         "日本語 テキスト ＡＢ", "😀👩‍👩‍👧 ok", "<|endoftext|> a <|startoftext|>", "a\r\n\tb   c", "%%% ### |x| www.a.org/b?c=1", "x" * 5000, "ab " * 9000]


def test_ids_are_the_tokenizers():
    path = vocabulary(PACKED_BY)
    own = Tokenizer.from_file(path)
    encoder = word_encoder(path)
    encoder.WORDS_KEPT = 3                              # emptied all the time
    for text in TEXTS * 2 + [" ".join(TEXTS)]:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == own.encode(text, add_special_tokens=False).ids, text


def test_pack(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "again"), (3, "again"), (50, None)]
    size = 64
    got = [r.asDict() for r in pack(docs(rows), vocabulary(PACKED_BY), size).collect()]
    own = Tokenizer.from_file(vocabulary(PACKED_BY))
    want, by_bin = Counter(), defaultdict(list)
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), size):
            part = ids[k:k + size]
            want[i, k // size, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by_bin.values():
        ends = [a + b for a, b in sorted(found)]
        assert [a for a, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= size
    lengths = [k[3] for k, n in want.items() for _ in range(n)]
    assert len(by_bin) == sum(best_fit(lengths, size).values())


def test_pack_nothing(docs):
    assert pack(docs([]), vocabulary(PACKED_BY)).collect() == []
