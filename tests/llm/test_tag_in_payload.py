import hashlib
import zlib

import pytest

from palimpsest.llm import mpeg_audio


def test_tag_in_the_last_frame(spark, documents):
    """Text that looks like an ID3v1 tag at the place of one is payload."""
    texts = ["x" * 29 + "TAG" + "y" * 96] + ["x" * k + "TAG" * 40 + "y" * (n - k) for n in (0, 60, 1400, 1500, 9000) for k in (0, 1, 2) if k <= n]
    rows = mpeg_audio.read_texts(mpeg_audio.store_texts(documents(texts))).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        data = text.encode()
        data = data.ljust(-(-len(data) // 64) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_real_tag_and_short_payload():
    media = mpeg_audio.carry(b"x" * 6400, 6400)
    plain, tagged = mpeg_audio.parse(media), mpeg_audio.parse(media + b"TAG" + b"title".ljust(125, b"\0"))
    assert tagged.tags["TIT2"] == "title" and (tagged.offsets, tagged.skipped) == (plain.offsets, 0)
    with pytest.raises(ValueError):
        mpeg_audio.payload(media[: len(media) - 400])
