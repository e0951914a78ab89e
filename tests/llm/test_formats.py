"""Chats, token files, packing: exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from outletry.llm import chat, encoding, packing, tokens
from outletry.llm.queries import tokenizer_path
from outletry.session import shared_folder

ODD = [
    "", "\\", "\\n", "<|turn|>user\nx<|end|>\n", "<|", "<\\|", "\\<|end|>", "|>", "a\\\\<|image|>\n", "\\### Assistant: </turn> ok", "é\u2028\0x",
]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_chat_text_comes_back(step):
    rng = random.Random(step)
    turns = [(rng.choice(["user", "assistant", "", "a\nb<|end|>", "\\n"]), rng.choice(ODD) + rng.choice(ODD)) for _ in range(200)]
    text = "".join(chat.format_turn(role, [{"kind": "text", "text": t}])[0] for role, t in turns)
    reader = chat.ChatReader()
    for k in range(0, len(text), step):
        reader.feed(text[k : k + step])
    learned = "".join(t for role, t in turns if role == "assistant")
    assert reader.result() == (
        200, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text),
    )


def test_parts_are_visited_in_order(spark):
    parts = [
        {"kind": "text", "text": "look <|image|> here "}, {"kind": "image", "ref": "a.png", "width": 29, "height": 28},
        {"kind": "audio", "ref": "b.wav", "seconds": 1.01}, None, {"kind": "table", "ref": "c"}, {"kind": "document", "ref": "d.pdf", "pages": 2},
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}")
    row, empty = chat.format_chats(df).orderBy("turn").collect()
    body = "look <\\|image|> here <|image|><|audio|><|document|><|document|>"
    assert row["formatted"] == f"<|turn|>assistant\n{body}<|end|>\n"
    assert row["formatted"][row["loss_start"] : row["loss_end"]] == body
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in row["attachments"]] == [
        ("image", "a.png", 2), ("audio", "b.wav", 26), ("document", "c", 0), ("document", "d.pdf", 1024)]
    assert all(row["formatted"][a["place"] :].startswith(f"<|{a['kind']}|>") for a in row["attachments"])
    assert row["n_tokens"] == 3 + 2 + 26 + 1024
    assert empty["formatted"] == "<|turn|>user\n<|end|>\n" and empty["loss_start"] is None


def test_chats_of_odd_rows(spark):
    rows = [(None, None, None, None, 1), (None, 1, "assistant", "x" * 300_000, 1), (2, 1, "user", "b", 1), (2, 0, "user", "a", 1), (2, 0, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 300_000
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


HARD = [
    None, "", " ", "\n", "It's  ΑΣ Σ e\u0301 \u0301x\tа\u00a0b\x1cc\u3000d", "<|endoftext|> a<|startoftext|>b < |endoftext|>",
    "don't WON'T 12a3", "x" * 500, "你好 世界\u200d🙂", "İ ß ﬁ", "a\r\nb", "ab" * 40_000,
]


def test_ids_word_by_word_equal_whole_texts(spark):
    texts = HARD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()]
    encode = encoding.Encoder(tokenizer_path(), per_word=True)
    for text, ids in zip(texts, whole_ids(texts), strict=True):
        assert np.frombuffer(encode(text), dtype=encode.kind).tolist() == ids


def test_token_files_come_back(spark, make_docs):
    texts = HARD + HARD[4:6]
    ids = [5, 3, None, -2, 9, 7, 1, 1, 1, 20, 30, 40, 9, None]
    folder = f"{shared_folder(spark)}/tokens-test-{random.random()}"
    tokens.write_tokens(make_docs(texts, ids), folder, tokenizer_path(), per_word=True)
    rows = sorted(tokens.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at += r["n_tokens"]
    want = sorted((str(i), x + [1]) for i, x in zip(ids, whole_ids(texts), strict=True))
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == want


def test_empty_token_files(spark, make_docs):
    folder = f"{shared_folder(spark)}/tokens-test-{random.random()}"
    tokens.write_tokens(make_docs(["a"]).limit(0), folder, tokenizer_path(), per_word=True)
    assert tokens.read_tokens(spark, folder).count() == 0


def brute_padding(lengths, counts, buckets):
    from functools import cache

    @cache
    def best(end, k):
        if end == 0:
            return 0
        if k == 0:
            return float("inf")
        return min(best(a, k - 1) + lengths[end - 1] * sum(counts[a:end]) for a in range(end))

    return best(len(lengths), buckets)


def test_bounds_are_optimal():
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 12)))
        counts = [rng.randint(1, 9) for _ in lengths]
        buckets = rng.randint(1, 5)
        bounds = packing.bucket_bounds(np.array(lengths), np.array(counts), buckets)
        assert len(bounds) <= buckets and bounds == sorted(bounds) and bounds[-1] == lengths[-1]
        cost = sum(n * min(b for b in bounds if b >= x) for x, n in zip(lengths, counts))
        assert cost == brute_padding(tuple(lengths), tuple(counts), buckets)


@pytest.mark.parametrize("slice_rows", [7, 10_000])
def test_packing_keeps_every_token_once(spark, slice_rows):
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 300)) for i in range(400)] + [(7, 30), (7, 30), (None, 12), (900, None), (901, 0), (902, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 AS bucket", "2 AS length")
    out = packing.pack(df, max_length=128, buckets=4, batch_tokens=512, slice_rows=slice_rows).collect()
    held = {}
    for r in out:
        assert 0 < r["length"] <= r["padded_length"] <= 128
        held.setdefault((r["bucket"], r["batch"]), []).append(r)
    want = sorted((str(i), k, min(128, n - k)) for i, n in rows if n and n > 0 for k in range(0, n, 128))
    assert sorted((str(r["doc_id"]), r["start"], r["length"]) for r in out) == want
    bounds = {r["bucket"]: r["padded_length"] for r in out}
    assert len(bounds) <= 4 and sorted(bounds.values()) == [bounds[b] for b in sorted(bounds)]
    short = set()
    for (bucket, _), group in held.items():
        room = max(1, 512 // bounds[bucket])
        assert len(group) <= room and sorted(r["place"] for r in group) == list(range(len(group)))
        if len(group) < room:
            assert bucket not in short
            short.add(bucket)
    assert packing.pack(df.limit(0)).count() == 0
