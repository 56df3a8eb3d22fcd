"""Archive round trip; token counts against the library on whole texts."""
import hashlib
import random

import pytest

from tablescope.llm import token_counts, warc
from tablescope.session import scratch_path


def test_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a/\r\nX: 3", big), (5, "http://a/5", big), (7, None, None),
            (8, "u", ""), (9, "u", "small"), (10, "u", "small"), (None, "u", big), (11, "u", "x" * 1000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    got = sorted(map(tuple, warc.read_records(spark, path).select(
        "id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    response = {"x": False}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        kind, to = "response", None
        if len(data) >= 1000 and html == big and (i != 5 or response["x"]):
            kind, to = "revisit", 5
        response["x"] |= i == 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, to))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = [bytes(r.record) for r in warc.reconstruct(spark, path).collect()]
    assert len(records) == len(rows)
    for r in records:
        head, rest = r.split(b"\r\n\r\n", 1)
        length = int(head.split(b"Content-Length: ")[1])
        assert rest[length:] == b"\r\n\r\n"
        if length:
            assert hashlib.sha1(rest[:length]).hexdigest().encode() in head
    assert any(b"http://a/%0D%0AX: 3" in r for r in records)


def test_empty_archive(spark):
    path = scratch_path(spark, "warc-none")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece
    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    bits = ["word", " ", "  ", "\n", "é", "▁", "<s>", " ▁", "日本", "a b", "\t", "supercalifragilistic", "</s> ", "."]
    texts = ["", None, " ", "  ", "a ", " a", "a  b", "a▁ b ", "end with blank "] + [
        "".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    want = [len(model.encode(t or "")) for t in texts]
    for size in (1, 7, 50):
        assert list(token_counts.token_lengths([t or "" for t in texts], path, 100, size)) == want
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)] + [(0, "", 0)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, path, limit=50).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want[r.doc_id], want[r.doc_id] > 50)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
