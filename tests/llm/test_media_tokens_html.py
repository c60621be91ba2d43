from __future__ import annotations

import hashlib
import io
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html, media, tokens


def test_netpbm_round_trips():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    color = rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    deep = rng.integers(0, 65536, (2, 3), dtype=np.uint16)
    bits = rng.integers(0, 2, (3, 11), dtype=np.uint8)
    plain = " ".join(map(str, grey.reshape(-1))).encode()
    assert (media.decode_netpbm(b"P5 7 5 255\n" + grey.tobytes()) == grey).all()
    assert (media.decode_netpbm(b"P2\n# note 9\n7 5\n255\n" + plain) == grey).all()
    assert (media.decode_netpbm(b"P6\n3 4\n255\n" + color.tobytes()) == color).all()
    assert (media.decode_netpbm(b"P3 3 4 255 " + " ".join(map(str, color.reshape(-1))).encode()) == color).all()
    assert (media.decode_netpbm(b"P5 3 2 65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    assert (media.decode_netpbm(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    assert (media.decode_netpbm(b"P1 11 3\n" + "".join(map(str, bits.reshape(-1))).encode()) == (1 - bits) * 255).all()


def bmp(pixels: np.ndarray, depth: int, palette: bytes = b"", down: bool = False) -> bytes:
    h, w = pixels.shape[:2]
    order = pixels if down else pixels[::-1]
    if depth == 24:
        rows = [r[:, ::-1].tobytes() for r in order]
    elif depth == 32:
        rows = [np.dstack([r[None, :, ::-1], np.zeros((1, w, 1), np.uint8)]).tobytes() for r in order]
    else:
        rows = [np.packbits(((r[:, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1)).tobytes() for r in order]
    line = (w * depth + 31) // 32 * 4
    body = b"".join(r.ljust(line, b"\0") for r in rows)
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, depth, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body


@pytest.mark.parametrize("down", [False, True])
def test_bmp_round_trips(down):
    rng = np.random.default_rng(2)
    color = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for depth in (24, 32):
        assert (media.decode_bmp(bmp(color, depth, down=down)) == color).all()
    for depth in (1, 4, 8):
        table = rng.integers(0, 256, (1 << depth, 4), dtype=np.uint8)
        index = rng.integers(0, 1 << depth, (6, 9))
        assert (media.decode_bmp(bmp(index, depth, table.tobytes(), down)) == table[:, 2::-1][index]).all()


def test_area_resize_is_the_mean_of_the_area():
    rng = np.random.default_rng(3)
    for h, w, th, tw in ((16, 18, 8, 9), (5, 7, 8, 9), (1, 64, 8, 9), (30, 11, 7, 3)):
        image = rng.integers(0, 256, (h, w)).astype(float)
        big = np.kron(image, np.ones((th, tw)))
        want = big.reshape(th, h, tw, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, th, tw), want)
    assert media.difference_hash(np.tile(np.arange(64), (8, 1))) == "f" * 16
    assert np.load(io.BytesIO(media.npy_tile(np.full((4, 4), 9)))).tolist() == [[9] * 16] * 16


def test_tiles_are_scaled_by_the_greatest_value(spark):
    deep = np.full((4, 5), 1000, dtype=">u2")
    images = [(1, b"P5\n5 4\n65535\n" + deep.tobytes()), (2, b"P5\n2 2\n15\n" + bytes([15] * 4)), (3, b"P2 1 1 4 2"), (4, b"P4 8 1\n\x00"), (5, b"P6 1 1 15\n" + bytes([15] * 3))]
    got = {r["k"]: np.load(io.BytesIO(r["tile"])) for r in media.media_columns(spark.createDataFrame(images, "k int, content binary")).collect()}
    assert [set(got[k].reshape(-1).tolist()) for k in range(1, 6)] == [{4}, {255}, {128}, {255}, {255}]


def test_strips_give_what_one_integral_image_gives(monkeypatch):
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (3, 70), (70, 3), (64, 64), (257, 31)):
        for image in (rng.integers(0, 256, (h, w)), rng.integers(0, 256, (h, w, 3), dtype=np.uint8)):
            whole = media.area_resizes(image, [(16, 16), (8, 9)])
            monkeypatch.setattr(media, "STRIP", 50)
            for a, b in zip(whole, media.area_resizes(image, [(16, 16), (8, 9)])):
                assert np.allclose(a, b)
            monkeypatch.undo()


def test_a_long_text_takes_little_more_than_its_size():
    text = "many words " * 400_000
    n, data = media.payload(text)
    image = media.decode_netpbm(media.encode_pgm(data))
    tracemalloc.start()
    media.features(image)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20


def test_media_columns(spark):
    good = media.encode_pgm(bytes(range(128)))
    rows = [(1, good, 5), (2, None, 5), (3, b"", 5), (4, b"P5 9", 5), (5, b"BM", 5), (6, b"P5 0 0 255\n", 5), (1, good, 5), (7, b"GIF89a", 5)]
    got = {r["id"]: r for r in media.media_columns(spark.createDataFrame(rows, "id int, content binary, width int")).collect()}
    assert (got[1]["height"], got[1]["width"]) == (2, 64) and np.load(io.BytesIO(bytes(got[1]["tile"]))).shape == (16, 16)
    assert all(got[i][c] is None for i in range(2, 8) for c in ("height", "width", "tile", "dhash"))


def test_media_documents(spark):
    long = "é" * 70000
    docs = [(1, "a"), (2, None), (3, ""), (4, "x" * 64), (5, "x" * 65), (6, long), (None, "a"), (1, "a")]
    rows = media.media_documents(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, feature int")).collect()
    assert len(rows) == len(docs)
    by_text = {}
    for (_, t), r in [(d, r) for r in rows for d in docs if d[0] == r["doc_id"]]:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert by_text.setdefault(t or "", r["feature"]) == r["feature"]
    assert media.media_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts_are_the_tokenizer_s(spark):
    texts = ["", None, "hello world", " two  spaces\n\n x", "it's we'll I'm", "<|endoftext|>a<|endoftext|>", "<|endof", "naïve café ÀÉ", "数 学 mixed", "  x", "٣٤ x²", "\x1c \x85y", "a" * 5000, "ab " * 3000, "😀 ok", "1234567 12.5%", "\ta\r\nb\x0bc", "<|endoftext|> 数", "x​y"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "hello world", 3)], "doc_id long, text string, n_tokens int").repartition(2)
    tokenizer = tokens.load_tokenizer(tokens.default_tokenizer())
    got = {r["doc_id"]: r for r in tokens.count_tokens(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), t
    assert tokens.count_tokens(df.where("false")).count() == 0


def test_settled_characters_are_split_as_the_tokenizer_splits_them():
    splitter, plain = tokens.Splitter(), tokens.load_tokenizer(tokens.default_tokenizer()).pre_tokenizer
    settled = [chr(c) for c in range(0x250, 0x20000) if not 0xD800 <= c < 0xE000 and not splitter.unsettled.search(chr(c))]
    assert len(settled) > 30_000
    for lo in range(0, len(settled), 64):
        text = "".join(f"a{c}b {c} 1{c}2{c}. {c}{c} 's{c}" for c in settled[lo : lo + 64])
        assert splitter.parts(text) == [text[b:e] for _, (b, e) in plain.pre_tokenize_str(text)]
    assert splitter.parts("curly “quotes” — and … more") is not None and splitter.parts("\ue000") is None


def test_a_small_cache_gives_the_same_counts():
    tokenizer = tokens.load_tokenizer(tokens.default_tokenizer())
    counting = tokens.Counting(tokenizer, {"the": 1}, cached=3)
    for k in range(50):
        text = f"the word{k} word{k + 1} and the rest{k}"
        assert counting.count([text]) == [len(tokenizer.encode(text).ids)]
    assert len(counting.lengths) < 20
    long = "y" * 5000
    assert counting.count([long, f"a {long} b"]) == [len(tokenizer.encode(x).ids) for x in (long, f"a {long} b")]
    assert max(map(len, counting.lengths)) <= tokens.LONGEST


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href=/a>Home, of, all</a></ul></nav><header><h2>Site</h2></header><div class="cookie-notice"><p>We use cookies, you know, a lot of them.</div>
<div class=ad>Buy, buy, buy</div><div id="wrap"><article><header><h1>Head &lt;1&gt;</h1></header><p><b>First,  one<br>two.<p>Second &eacute;&#33; para<i>graph</i>.</p><!-- <p>no</p> -->
<ul><li>x<li>y</ul><form><p>Your name, please</form><p>Third.</p><aside><p>Aside, aside</aside><section><p>Last</section></article><div class="comments"><p>Great, great, great, great, article, I think, it is long.</div></div>
<div class="sidebar"><p>Also, read</div><footer>&copy; me, you</footer></body></html>"""


def test_article_of_a_page():
    assert html.main_text(PAGE) == "Head <1>\nFirst, one two.\nSecond é! paragraph.\nx\ny\nThird.\nLast"


@pytest.mark.parametrize(
    "before, after",
    [
        ("<div class='content has-sidebar'>", "</div>"),
        ("<div id='page' class='no-header'>", "</div>"),
        ("<article class='post comments-open'>", "</article>"),
        ("<article class='post widget'>", "</article>"),
        ("<div class='layout sidebar'><article>", "</article></div>"),
        ("<div class='ad-free overlay'><div class=story>", "</div></div>"),
    ],
)
def test_wrappers_named_like_furniture(before, after):
    body = "<p>" + "</p><p>".join("Some words, and more of them, to fill a line of text. " * 4 for _ in range(3)) + "</p>"
    page = f"<body>{before}{body}<div class=comments><p>a, comment, of some, one</p></div>{after}<div class=sidebar><p>Also, read</p></div>"
    text = html.main_text(page)
    assert text.count("fill a line") == 12 and "comment" not in text and "Also" not in text


def test_pages_without_an_article_element():
    body = "".join(f"<p>Sentence {k}, with, commas, and enough of a length to be a paragraph.</p>" for k in range(4))
    page = f"<body><div class=menu><a href=x>a, b, c</a></div><div><div id=c>{body}<h3>End</h3>tail text</div><div class=related>no, no, no</div></div><p>(c) x"
    lines = html.main_text(page).split("\n")
    assert len(lines) == 6 and lines[-2:] == ["End", "tail text"]


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>", ""), ("a < b & c", "a < b & c"), ("<div><p>one<div>two</div>", "one\ntwo"), ("<script>x</script>", ""), ("<p>x<script>never ends", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p title='a>b'>ok</p>", "ok"), ("<p hidden>no</p><p>yes</p>", "yes")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_pages(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "<p>x &amp; y" * 3, "t"), (1, "u", PAGE, "t"), (3, "v", "<b>" * 20000 + "deep", "t"), (4, "w", "<p>long " + "x " * 200000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[4] == 4 + 2 * 200000
    assert html.extract_pages(df.where("false")).count() == 0


def test_odd_documents(spark):
    """Empty tables, a very long text, repeated rows and clashing columns: media, tokens, personal data."""
    from tessera.llm import pii

    long = "Write to a.b@example.org or +1 (415) 555-2671. " * 20_000
    docs = spark.createDataFrame([(1, long, "x"), (2, "same", "y"), (2, "same", "y"), (None, None, None)], "doc_id long, text string, spans string").withColumns({c: F.lit(7) for c in ("n_bytes", "feature", "n_email")})
    images = media.media_documents(docs).collect()
    assert sorted(r.n_bytes for r in images) == [0, 4, 4, len(long)] and len({r.feature for r in images if r.doc_id == 2}) == 1
    counts = tokens.count_tokens(docs).collect()
    assert sorted(r.n_bytes for r in counts) == [0, 4, 4, len(long)] and {r.n_email for r in counts} == {7}
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert found[1].n_email == found[1].n_phone == 20_000 and found[2].spans == "" and found[None].n_ip == 0
    none = docs.where("doc_id > 9")
    assert media.media_documents(none).count() == tokens.count_tokens(none).count() == pii.find_personal_data(none).count() == 0
