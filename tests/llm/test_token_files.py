from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelgrid.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query(documents, result):
    rows, start = result("op8_token_files"), 0
    ordered = sorted(documents)
    for (doc, _, _), ids in zip(ordered, plain([t for _, t, _ in ordered])):
        data = np.array(ids + [2], "<u4")
        assert (rows[doc]["start"], rows[doc]["n_tokens"], rows[doc]["ids_crc32"]) == (start, len(data), zlib.crc32(data.tobytes()))
        start += len(data)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 65_537, 200_001])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    planes = tf.pack(ids, kind)
    assert len(planes) == -(-n // tf.BLOCK) * (4 if kind == "byte" else 32)
    assert (tf.unpack(planes, n, kind) == ids).all()


def test_planes_are_transposed():
    ids = np.array([1, 256, 65536 + 1], "<u4")
    assert tf.to_planes(ids, "byte") == [b"\1\0\1", b"\0\1\0", b"\0\0\1", b"\0\0\0"]
    assert tf.to_planes(ids, "bit")[0] == b"\5"


def test_word_ids_equal_whole_text_ids(monkeypatch):
    odd = [chr(a) + chr(b) + "x" for a in range(0x260) for b in (32, 39, 0x41, 0xE9, 0x301, 0x130, 48, 33, 0x85, 0xA0, 0x1C, 9)]
    odd += ["it's 'S <|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "İ ΑΣ Σ", "ﷺ ½ ² ȩ́", "한국 각 中文", "a\r\n\tb", "", " ", "  a  "]
    for most in (10**6, 50):
        monkeypatch.setattr(tf, "REMEMBERED", most)
        coder = tf.WordEncoder(PATH)
        for at in range(0, len(odd), 700):
            some = odd[at : at + 700]
            assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(some, 2)] == [i + [2] for i in plain(some)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_odd_rows_in_small_chunks(spark, odd, none, tmp_path, monkeypatch, kind):
    folder = str(tmp_path / "out")
    tf.write_token_files(odd, PATH, folder, kind=kind)
    rows = sorted(tf.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"], r["text"]) for r in odd.collect()),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [d for d, _ in texts]
    for (_, text), row, ids in zip(texts, rows, plain([t for _, t in texts])):
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids + [2] and row["n_tokens"] == len(ids) + 1
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows][:-1]]).tolist()
    tf.write_token_files(none, PATH, folder + "-none")
    assert tf.read_token_files(spark, folder + "-none").collect() == []


class Counted(dict):
    """A memory that counts how often pieces are looked up."""

    asked = 0

    def get(self, piece, other=None):
        self.asked += 1
        return super().get(piece, other)

    def __getitem__(self, piece):
        self.asked += 1
        return super().__getitem__(piece)

    def __contains__(self, piece):
        self.asked += 1
        return super().__contains__(piece)


def test_pieces_are_looked_up_once_for_many_texts():
    coder = tf.WordEncoder(PATH)
    texts = ["alpha beta\ngamma delta " * 50] * 40
    expected = coder.encode(texts, 2)
    coder.known = Counted(coder.known)
    assert coder.encode(texts, 2) == expected
    assert coder.known.asked <= 50


def test_words_are_encoded_once_for_all_cases_and_marks(monkeypatch):
    coder, sent = tf.WordEncoder(PATH), []
    for name in ("_alone", "_together"):
        monkeypatch.setattr(coder, name, lambda some, f=getattr(coder, name): (sent.extend(some), f(some))[1])
    texts = ["Größe größe, GRÖSSE. größe! (größe) don't Don't, 'größe's' x_1 ¿größe? »größe«", None, "größe größe; GRÖßE"]
    ids = [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts, 2)]
    assert ids == [i + [2] for i in plain(texts)]
    assert sent.count("größe") == 1 and not [w for w in sent if "größe" in w.lower() and w != "größe"]


def test_a_batch_with_more_new_pieces_than_room_fills_the_memory(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 50)
    coder = tf.WordEncoder(PATH)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts, 2)] == [i + [2] for i in plain(texts)]
        assert len(coder.known) == 50


def test_plain_pieces_of_every_character():
    coder = tf.WordEncoder(PATH)
    odd = [t for c in map(chr, range(0x250)) for t in (f"a{c}b", f"{c}1{c}{c}", f"-{c}'s", f"'{c}'LL", f"A{c}́", f"J̌{c}")]
    for some in (odd, [" ".join(odd)], ["\n".join(odd) + "\n"]):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(some, 2)] == [i + [2] for i in plain(some)]


def test_slices_hold_all_rows_in_order(monkeypatch):
    texts = [None, "", "a" * 25, "b" * 9, None, "ü" * 5, "c", "d" * 40, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    monkeypatch.setattr(tf, "TEXT_BYTES", 10)
    found = [s.column(0).to_pylist() for s in tf._slices(batch)]
    assert sum(found, []) == list(range(len(texts))) and len(found) > 3 and all(found)
    assert [s.num_rows for s in tf._slices(batch.slice(0, 0))] == []


@pytest.mark.parametrize("change", ["none", "case", "digits", "added"])
def test_other_tokenizers_that_cut_at_spaces(tmp_path, change):
    with open(PATH) as f:
        made = json.load(f)
    if change == "case":
        made["normalizer"]["normalizers"].pop()
    if change == "digits":
        split = made["pre_tokenizer"]["pretokenizers"][0]
        split["pattern"]["Regex"] = split["pattern"]["Regex"].replace(r"[\p{N}]|", r"[\p{N}]+|")
    if change == "added":
        made["added_tokens"].append({**made["added_tokens"][1], "id": 49408, "content": "[END]"})
    with open(path := str(tmp_path / "tokenizer.json"), "w") as f:
        json.dump(made, f)
    texts = ["Alpha ALPHA alpha, don't DON'T 1234 12,5 [END] x[END]y größe-GRÖSSE", None]
    coder = tf.WordEncoder(path)
    whole = Tokenizer.from_file(path).encode(texts[0], add_special_tokens=False).ids
    assert coder.cuts == (change == "none")
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts, 2)] == [whole + [2], [2]]
