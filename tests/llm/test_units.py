"""The operators' parts without Spark, against brute force."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import bpe, chat, common, decontam, linededup, lmscore, media, neardup, shingles, toxicity, warc
from quern.llm.queries import CONTROL_TEXT, word_bpe_path


def png(width=3):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(width + 1))) + part(b"IEND", b"")


def test_sniffing_carves_and_rejects():
    inside, packed = png(), gzip.compress(b"x" * 5000)
    blob = b"junk BM RIFF GIF89a" + inside + b"%PDF-1.4" + packed + png()[:-5]
    assert media.sniff(blob) == [(19, 19 + len(inside), "image/png"), (27 + len(inside), 27 + len(inside) + len(packed), "application/gzip")]
    for raw in (b"", b"a", b"\0" * 64, "é".encode() * 100, b"x" * 64):
        wav = media.wav_of(raw)
        assert media.sniff(wav) == [(0, len(wav), "audio/wav")]
        own = media.chunks(wav)
        assert own[b"data"] == raw + bytes((-len(raw)) % 64 or (0 if raw else 64)) and struct.unpack("<Q", own[b"qlen"])[0] == len(raw)
    assert media.sniff(media.wav_of(b"abc")[:-1]) == []


@pytest.mark.parametrize("text", ["", CONTROL_TEXT, "<|", "<\\|x", "<\\\\|", "a<<|b\\", "<|<|\\|>", "\n<|image|>\n"])
def test_chat_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text
    segment, a, b, _ = chat.format_turn("assistant", [{"type": "text", "text": text}], frozenset({"assistant"}))
    assert chat.unescape(segment[a:b]) == text and chat._SEGMENT.fullmatch(segment)


def test_chat_parts():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i", "width": 57, "height": 28}, {"type": "audio", "ref": "a", "millis": 90}, {"type": "document", "ref": "d", "pages": 2}]
    segment, a, b, found = chat.format_turn("user", parts, frozenset())
    assert segment == "<|im_start|>user\nsee <|image|><|audio|><|document|><|im_end|>\n" and a == b
    assert [(x["ref"], x["tokens"]) for x in found] == [("i", 3), ("a", 3), ("d", 1024)]
    with pytest.raises(ValueError, match="unknown content part"):
        chat.format_turn("user", [{"type": "hologram"}], frozenset())


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = word_bpe_path()
    own, other = bpe.load(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "ab 'stdremvlĺéΣİ<|>endoftext1٩中\n\t\x1c\x85\U0001f600"
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b", "don't THEY'RE", "x" * 3000, "é" * 500] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = other.encode(text, add_special_tokens=False).ids
        assert ids == want and own.decode(ids) == other.decode(want, skip_special_tokens=False)


def test_bpe_merges_agree():
    own = bpe.load(word_bpe_path())
    rng = random.Random(4)
    words = [[rng.randrange(400) for _ in range(rng.randrange(2, 17))] for _ in range(300)]

    def slow(ids):
        while True:
            found = [(own.pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in own.pairs]
            if not found:
                return ids
            _, i = min(found)
            ids = [*ids[:i], own.pairs[ids[i], ids[i + 1]][1], *ids[i + 2 :]]

    assert [bpe.merge(w, own.pairs) for w in words] == bpe.merge_all(words, own.ranks) == [slow(w) for w in words]


def test_warc_round_trip_and_damage():
    pages = [(i, f"http://x/{i}\r\nA: b", f"<p>page {i}</p>".encode() * 40) for i in range(60)]
    records = [warc.build_record(i, u, p, warc.digest_of(p), 9, i == 3) for i, u, p in pages]
    archive = warc.pack(records)
    assert list(warc.unpack(archive)) == records
    headers, block = warc.parse_record(records[3])
    assert headers["warc-type"] == "revisit" and headers["x-refers-to-page"] == "9" and block.endswith(b"\r\n\r\n")
    assert list(warc.unpack(warc.pack([records[0]]))) == records[:1]
    for bad in (archive[:-3], archive[:10]):
        with pytest.raises(warc.WarcError):
            list(warc.unpack(bad))
    for bad in (records[0][:-1], records[0].replace(b"Content-Length", b"Content-Longth"), b"WARC/9\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_shingles_and_pigeonhole():
    assert len(shingles.shingle_set(None)) == len(shingles.shingle_set(" \n\x0b")) == 0
    assert len(shingles.shingle_set("a b c")) == 1 and len(shingles.shingle_set("A b  c D e f")) == 2
    assert (shingles.shingle_set("A B c d e") == shingles.shingle_set("a b C\x0cd\te")).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, neardup.POSITIONS), dtype=np.uint16)
    b = a.copy()
    for row in b:  # as many errors as the pigeonhole allows: a chunk with one at most remains
        at = rng.choice(neardup.POSITIONS, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)
        row[at] ^= 1
    x, y = neardup.keys_of(a), neardup.keys_of(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))
    assert not set(x[0].tolist()) & set(x[1].tolist())


def test_words_and_shapes_of_whole_columns():
    import pyarrow as pa

    texts = [None, "", " a\x0bB  c\x1c\x85 ", "\u3000x\xa0y É", "Don't 7up, stop. ABCDEFGHIJKLMNOP né ń"]
    words, sizes = shingles.split_words(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in shingles.words_of(t)] and sizes.tolist() == [len(shingles.words_of(t)) for t in texts]

    def slow(w):
        if not w.isascii():
            i = next(i for i, b in enumerate(w) if b > 127)
            return 11 + (w[i] * 31 + (w[i + 1] if i + 1 < len(w) else 0)) % 13
        return 10 if any(48 <= b < 58 for b in w) else min(4, max(0, len(w) - 3) // 2) * 2 + (w[-1] in b".,;:!?")

    assert lmscore.shapes_of(words).tolist() == [slow(w) for w in words.to_pylist()]
    assert lmscore.shapes_of(words.slice(3, 2)).tolist() == lmscore.shapes_of(words).tolist()[3:5] and not len(lmscore.shapes_of(words.slice(0, 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 1, 1, 9, 0, 3)])], names=["t"])
    assert [p.num_rows for p in common.slices(batch, 0, 4)] == [1, 2, 1, 2]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_automaton_finds_all():
    terms = ["idiot", "moron", "disgusting", "scum", "low*"]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(2)
    tokens = ["lowly", "scum", "scun", "idi0t"] + ["".join(rng.choice("diotmrnsgu") for _ in range(rng.randrange(3, 12))) for _ in range(2000)]
    for t in terms[:3]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = rng.choice(["", "x", "o"])
            tokens.append("".join(w))
    for token in tokens:
        near = [(levenshtein(token, t), t) for t in terms[:4] if levenshtein(token, t) <= toxicity.allowed(t)]
        want = ("low*", 0) if token.startswith("low") else (min(near)[1], min(near)[0]) if near else None
        assert lexicon.nearest(token) == want, token


def test_quotation_counts_less():
    model = toxicity.Model({"idiot": 5.0}, frozenset({"idiom"}), [-3.0, 3.0, 0.5, 1.0, 0.0])
    plain, quoted, none = (model.score(t) for t in ("you are an idiot", 'he wrote "idiot" there', "an idiom"))
    assert plain > 0.5 > quoted > none == model.score("")
    assert model.hits("IDIOTS!")[0][:3] == ("idiots", "idiot", 1)
    long = "word " * 60
    inside = {text: model.hits(text)[0][3] for text in (f'"{long}idiot {long}"', f'"{long}" you idiot "{long}"', f'5" wide\n"an idiot"', "“an idiot”", "“an” idiot", "no idiot")}
    assert list(inside.values()) == [True, False, True, True, False, False]


def test_masks_reach_every_substitution():
    longest = 40
    for least, wrong, masks in decontam.TIERS:
        above = min((t[0] for t in decontam.TIERS if t[0] > least), default=longest)
        for n in range(least, min(above, decontam.WINDOW + 1)):
            for bad in itertools.combinations(range(n), wrong):
                fits = ((m, at) for m in masks for at in range(n - len(m) + 1))
                assert any(all(c == "0" or at + i not in bad for i, c in enumerate(m)) for m, at in fits), (n, bad)


def test_lines_and_chunks_are_shift_resistant():
    assert linededup.lines_of("") == ([], []) and linededup.lines_of(" \n ") == ([], [])
    text = "One two. Three four!\n\nFive? 3.5 is a number\n"
    lines, ends = linededup.lines_of(text)
    assert lines == ["One two.", "Three four!", "Five?", "3.5 is a number"] and ends[-1] == len(text)
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    one = set(linededup.chunks_of(h, np.array([400]))[2].tolist())
    two = set(linededup.chunks_of(np.concatenate([h[:3] + np.uint64(1), h]), np.array([403]))[2].tolist())
    assert len(one - two) <= 2
    both = linededup.chunks_of(np.concatenate([h, h]), np.array([400, 400]))[2].tolist()
    assert both[: len(both) // 2] == both[len(both) // 2 :]


def test_digest_is_that_of_hashlib():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39a3ee")


def test_runs_of_repeated_lines_against_a_plain_version():
    rng = random.Random(2)
    for _ in range(100):
        rows, want = [], []
        for i in range(rng.randrange(1, 6)):
            n = rng.randrange(1, 30)
            h, e, w = [rng.randrange(50) for _ in range(n)], np.cumsum([rng.randrange(1, 9) for _ in range(n)]).tolist(), [rng.randrange(1, 20) for _ in range(n)]
            own, runs = rng.sample(range(n), rng.randrange(1, n + 1)), []
            rows.append((rng.choice([None, i]), i, np.array(h, np.int64).tobytes(), np.array(e, np.int32).tobytes(), np.array(w, np.int32).tobytes(), own))
            for line in sorted(own):
                if runs and runs[-1][-1] == line - 1:
                    runs[-1].append(line)
                else:
                    runs.append([line])
            for r in (r for r in runs if sum(w[x] for x in r) >= linededup.MIN_WORDS):
                want += [(h[x], rows[-1][0], i, x, e[x - 1] if x else 0, e[x], w[x], sum(w)) for x in r]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int32())]
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list("abcdef"))
        assert [tuple(r.values()) for out in linededup._occurrences(iter([batch])) for r in out.to_pylist()] == want
