import time
import zlib
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import token_files as K

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
IDS = K.Ids(PATH)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=40) | st.text(max_size=20))
def test_pieces_are_the_tokenizers(text):
    for t in (text, text.replace("a", " "), text + "  \n x'll  "):
        assert IDS.encode([t])[0].tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_every_character_and_special_strings():
    every = "".join(map(chr, range(0x250)))
    texts = [every, "".join(f"{c} {c}1 a{c}" for c in every), "<|endoftext|> x", None, ""]
    assert [x.tolist() for x in IDS.encode(texts)] == [plain_ids(t)[:-1] for t in texts]


def streams(rng):
    text = rng.zipf(1.3, 3000) % 50_000
    return [
        np.array([], int),
        np.array([0]),
        np.array([65534] * 30),
        rng.integers(0, 65535, 2048),
        text[:2048],
        np.tile(text[:37], 40),
        np.arange(2048),
        np.zeros(2048, int),
        np.array([50256, 0, 1, 2, 3, 7, 8, 15, 16, 255, 256, 32767, 32768]),
    ]


@pytest.mark.parametrize("lanes", [2048, 4])
def test_round_trip(monkeypatch, lanes):
    monkeypatch.setattr(K, "LANES", lanes)
    blocks = streams(np.random.default_rng(0)) * 2
    bodies = K.encode_blocks(blocks)
    assert bodies[: len(blocks) // 2] == bodies[len(blocks) // 2 :]
    for got, want in zip(K.decode_blocks(bodies), blocks):
        assert got.tolist() == want.tolist()
    for i in (4, 5):
        assert K.decode_blocks([bodies[i]])[0].tolist() == blocks[i].tolist()
    assert len(bodies[7]) < 120 and len(bodies[5]) < 500 and len(bodies[3]) < 2048 * 2.4


def test_damage_is_seen():
    rng = np.random.default_rng(1)
    body = K.encode_blocks([rng.zipf(1.4, 500) % 50_000])[0]
    for at in range(len(body)):
        broken = bytearray(body)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            K.decode_blocks([bytes(broken)])
    for cut in (body[:-1], body + b"x", b"", body[:10]):
        with pytest.raises(ValueError):
            K.decode_blocks([cut])
    with pytest.raises(ValueError):
        K.encode_blocks([np.array([65536])])


@pytest.mark.parametrize("size", [1, 2, 17, 300, 200_000, 4_000_000])
def test_vocabularies_of_any_size(size):
    rng = np.random.default_rng(9)
    blocks = [rng.integers(0, size, n) for n in (0, 1, 200, 70)] + [np.full(40, size - 1), np.zeros(300, int)]
    for got, want in zip(K.decode_blocks(K.encode_blocks(blocks, size)), blocks):
        assert got.tolist() == want.tolist()


def test_each_order_saves_bytes():
    rng = np.random.default_rng(10)
    drawn = rng.zipf(1.5, 2048) % 50_000  # order 0: few ids come often
    after = {i: int(rng.integers(0, 50_000)) for i in range(40)}
    pairs = [x for i in rng.integers(0, 40, 1024) for x in (int(i), after[int(i)])]  # order 1: an id says the next
    phrase = rng.integers(0, 9, 700)  # order 2: two ids say more than one
    sizes = [len(K.encode_blocks([np.array(x)], 50_257)[0]) for x in (rng.integers(0, 50_257, 2048), drawn, pairs, np.tile(phrase, 2))]
    assert sizes[0] < 2048 * 2.4 and sizes[1] < 2048 * 1.2 and sizes[2] < 2048 * 0.7 and sizes[3] < 1400 * 0.6


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_crc(a, b):
    assert K.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block,lanes", [(2048, 2048), (16, 3)])
def test_documents(spark, tmp_path, monkeypatch, block, lanes):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "LANES", lanes)
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(rng.choice(["the", "of", "élan", "x#y", "字"], int(rng.integers(0, 70)))), 1) for i in rng.permutation(90)]
    rows += [(None, "none"), (None, None), (7, rows[0][1]), (7, "again"), (7, "again"), (-5, ""), (400, "word " * 3000)]
    rows = [(r[0], r[1], 1) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    path = f"{tmp_path}/files"
    K.write(docs, path, PATH)
    want, start = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(plain_ids(text), "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, K.digests(K.read(spark, path)).collect()), key=lambda r: r[1])
    assert got == want


def test_empty_table(spark, tmp_path):
    K.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/files", PATH)
    assert K.digests(K.read(spark, f"{tmp_path}/files")).collect() == []


def test_coding_costs_less_than_tokenizing():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(n))) for n in rng.integers(2, 9, 30_000)]
    texts = [" ".join(words[i] for i in rng.zipf(1.2, 4000) % 30_000) for _ in range(150)]
    started = time.process_time()
    plain = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    tokenized = time.process_time() - started
    stream = np.concatenate([np.array(x, np.int32) for x in plain])
    blocks = [stream[i : i + 2048] for i in range(0, len(stream), 2048)]
    started = time.process_time()
    bodies = K.encode_blocks(blocks, 50_257)
    found = K.decode_blocks(bodies)
    assert time.process_time() - started < tokenized
    assert all(np.array_equal(a, b) for a, b in zip(found, blocks))


def test_every_id_keeps_a_part():
    assert (K._TOTAL - K._PART2 - K._PART1).min() >= K.BLOCK
    rng = np.random.default_rng(12)
    sure = np.tile([5, 6, 7], 1300)
    blocks = [np.append(sure, rng.permutation(50_000)[:190]), np.append(np.arange(4000), sure[:96]), np.repeat([3, 1], 2048)]
    for got, want in zip(K.decode_blocks(K.encode_blocks(blocks, 50_257)), blocks):
        assert got.tolist() == want.tolist()


def test_batches_are_split(monkeypatch):
    texts = ["it's  we'll", None, "", "\n'tis 'S 're", "x" * 50, "é'd ''s a'", " ", "字 a"]
    want = IDS.encode(texts)
    monkeypatch.setattr(K, "_CHARS", 4)
    monkeypatch.setattr(K, "_PIECES", 3)
    for got in (K.Ids(PATH).encode(texts), want):
        assert [x.tolist() for x in got] == [plain_ids(t)[:-1] for t in texts]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **kinds):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **kinds)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_new_words_share_a_call():
    words = ["".join(x) for x in product("bdflmnprst", repeat=3)]
    text = " ".join(words) + "\n\xa0é 12 \xa0é  'll"
    ids = K.Ids(PATH)
    ids.tokenizer = Counted(ids.tokenizer)
    if hasattr(ids, "joined"):
        ids.joined = Counted(ids.joined)
    assert ids.encode([text])[0].tolist() == plain_ids(text)[:-1]
    assert ids.tokenizer.texts + ids.joined.texts < 50


def test_words_used_again_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(K, "_PIECES", 50)
    ids = K.Ids(PATH)
    for i in range(20):
        text = f" again and{''.join(f' w{i}q{j}' for j in range(9))}"
        assert ids.encode([text])[0].tolist() == plain_ids(text)[:-1]
    learned = []
    ids._learn = lambda pieces, learn=ids._learn: (learned.extend(pieces), learn(pieces))[1]
    for i in range(20, 60):
        ids.encode([f" again and w{i}q"])
    assert b" again" not in learned and " again" not in learned
    assert len(ids.at) <= 60
