import base64
import hashlib
import random

import pytest

from hashloom.llm import media
from llm_data import CLASHING, prose

PIXEL = b"\x89PNG tiny"
SHA = hashlib.sha256(PIXEL).hexdigest()
URI = "data:image/png;base64," + base64.b64encode(PIXEL).decode()
PAGE = f"""<html><head><title>no</title></head><body><nav>skip</nav><h1>Head &amp; line</h1><p>One <b>two</b>
three <img src="/a.png" alt=" A  picture "> four</p>
<figure><img src="{URI}"><figcaption>Shown <i>here</i></figcaption></figure>
<video><source src="v.mp4"><source src="v.webm">old browser</video>
<script>if (a < b) {{}}</script><p>last</p>
<img src="https://x.example/{SHA}.jpg"><img alt="nothing"></body></html>"""


def pages(spark, rows, clashing=False):
    schema = "page_id bigint, url string, html string" + "".join(f", {c} string" for c in CLASHING if clashing)
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING) if clashing else [])) for r in rows], schema)


def payloads(spark, rows):
    return spark.createDataFrame(rows, "digest string, mime string, payload binary")


def test_order_captions_and_references(spark):
    (r,) = media.interleave(pages(spark, [(1, "https://site.example/dir/p.html", PAGE)])).collect()
    assert [p.position for p in r.parts] == list(range(len(r.parts)))
    got = [(p.kind, p.text or p.url, p.digest, p.caption, p.mime, p.payload_bytes, p.resolved) for p in r.parts]
    assert got == [
        ("text", "Head & line", None, None, None, None, None),
        ("text", "One two three", None, None, None, None, None),
        ("image", "https://site.example/a.png", None, "A picture", None, None, False),
        ("text", "four", None, None, None, None, None),
        ("image", None, SHA, "Shown here", "image/png", len(PIXEL), True),
        ("video", "https://site.example/dir/v.mp4", None, None, None, None, False),
        ("text", "last", None, None, None, None, None),
        ("image", f"https://x.example/{SHA}.jpg", SHA, None, "image/png", len(PIXEL), True),
        ("image", None, None, "nothing", None, None, False),
    ]


def test_payloads_of_a_table(spark):
    known = payloads(spark, [(SHA.upper(), "image/webp", b"abc"), (SHA, "image/png", b"abcdef"), (None, "x", b""), ("00", None, None)])
    (r,) = media.interleave(pages(spark, [(1, None, f"<img src='{SHA}.png'><img src='{'0' * 64}.png'>")]), known).collect()
    assert [(p.mime, p.payload_bytes, p.resolved) for p in r.parts] == [("image/png", 6, True), (None, None, False)]
    (r,) = media.interleave(pages(spark, [(1, None, PAGE)]), payloads(spark, [])).collect()
    assert not any(p.resolved for p in r.parts)


def test_joins_against_a_lookup(spark):
    """Many pages with shared digests, against a dictionary."""
    raw = [bytes([k]) * (k + 1) for k in range(20)]
    digests = [hashlib.sha256(b).hexdigest() for b in raw]
    rows = [(i, f"https://h.example/{i}", "".join(f"<p>t{k}</p><img src='/{digests[k]}'>" for k in range(i % 20, -1, -3))) for i in range(120)]
    out = media.interleave(pages(spark, rows), payloads(spark, [(d, "image/gif", b) for d, b in zip(digests[:15], raw)])).collect()
    assert sorted(r.page_id for r in out) == list(range(120))
    size = {d: len(b) for d, b in zip(digests[:15], raw)}
    for r in out:
        ks = list(range(r.page_id % 20, -1, -3))
        assert [p.text for p in r.parts[::2]] == [f"t{k}" for k in ks]
        assert [(p.digest, p.payload_bytes) for p in r.parts[1::2]] == [(digests[k], size.get(digests[k])) for k in ks]


def test_text_round_trip(spark):
    """All words of paragraphs come back in order."""
    words = [f"w{k}" for k in range(2000)]
    html = "<div>" + "".join(f"<p>{' '.join(words[k : k + 7])}</p>" + ("<img src=x.png>" if k % 3 else "") for k in range(0, 2000, 7)) + "</div>"
    (r,) = media.interleave(pages(spark, [(1, "https://e.example/", html)])).collect()
    assert " ".join(p.text for p in r.parts if p.kind == "text").split() == words


def test_broken_html_and_addresses(spark):
    rows = [
        (1, "https://[bad", "<img src='http://[x'>"), (2, None, "<p>open <b>tags <img"), (3, "", "</p></div>text<figure><img src=a><figcaption>cap"),
        (4, "u", "<script>never closed <p>x"), (5, "u", "<img src='data:nope'><img src='data:image/png;base64,@@@'>"), (6, "u", "<![CDATA[x]]><!-- c --><?php ?>y"),
    ]
    out = {r.page_id: r.parts for r in media.interleave(pages(spark, rows)).collect()}
    assert len(out) == 6
    assert [p.resolved for p in out[5]] == [False, False]
    assert out[3][-1].caption == "cap"


def test_awkward_rows(spark):
    rows = [(None, None, None), (1, None, None), (2, "u", ""), (3, "u", "   "), (4, "u", PAGE), (4, "u", PAGE), (4, "v", PAGE), (None, "u", "<p>x</p>"), (5, "u", "<p>word</p>" * 50_000)]
    out = media.interleave(pages(spark, rows, clashing=True)).collect()
    assert len(out) == len(rows)
    assert sorted(len(r.parts) for r in out) == [0, 0, 0, 0, 1, 9, 9, 9, 50_000]
    assert media.interleave(pages(spark, [])).count() == 0


def shown(html):
    return [p["text"] or p["url"] for p in media.read_page(html)[0]]


def test_forgotten_end_tags_lose_nothing():
    assert shown("<!DOCTYPE html><html><head><title>no</title><style>x</style><body><p>one</body>") == ["one"]
    assert shown("<title>no <img src=no></title><meta charset=utf-8><p>one<p>two") == ["one", "two"]
    assert shown("<head><title>no</title><p>one<img src=a>") == ["one", "a"]
    for tag in ("nav", "footer", "aside", "noscript", "template", "svg", "video", "audio"):
        assert [x for x in shown(f"<body><div><{tag}><p>one</p></div><p>two <img src=a></p></body>") if x] == ["one", "two", "a"]
        assert [x for x in shown(f"<p>zero</p><{tag}><p>one</p><img src=a><p>two") if x] == ["zero", "one", "a", "two"]
        assert [x for x in shown(f"<{tag}>no</{tag}><p>one<{tag}>two</body></html>") if x] == ["one", "two"]
    assert shown("<video src=v><audio src=a>no</video><p>one") == ["v", "a", "one"]
    assert shown("<video src=v><p>one</p><video><source src=w>no</video><p>two") == ["v", "one", "w", "two"]
    assert shown("<nav><aside>no</nav><p>one") == ["one"]


def test_media_of_elements_without_text():
    for tag in ("nav", "footer", "aside", "noscript"):
        assert shown(f"<p>one</p><{tag}>no <figure><img src=a><figcaption>no</figcaption></figure> no</{tag}>two") == ["one", "a", "two"]
    assert shown("<svg><title>no</title><image xlink:href=a /><text>no</text></svg><template>no<img src=b></template><script>no</script>") == ["a"]
    (p,) = media.read_page("<figure><img src=a><figcaption>said<svg><title>no</title></svg> <script>no</script>here<aside>no</aside></figcaption></figure>")[0]
    assert p["caption"] == "said here"


@pytest.mark.parametrize(
    "html, want",
    [
        ('<base href="/img/"><base href="/no/"><img src="a.png">', [("image", "https://e.example/img/a.png")]),
        ('<img src="data:image/gif;base64,R0lGOA==" data-src="/real.jpg">', [("image", "https://e.example/real.jpg")]),
        ('<img srcset="/s.jpg 320w, /l.jpg 1280w,/m.jpg 640w">', [("image", "https://e.example/l.jpg")]),
        ('<img srcset="/one.jpg, /two.jpg 2x">', [("image", "https://e.example/two.jpg")]),
        ('<img src="/plain.jpg" srcset="/two.jpg 2x">', [("image", "https://e.example/plain.jpg")]),
        ('<picture><source srcset="/w.webp 1x, /w2.webp 2x"><img alt="x"></picture><img alt="y">', [("image", "https://e.example/w2.webp"), ("image", None)]),
        ('<picture><source srcset="/w.webp"><img src="/f.jpg"></picture>', [("image", "https://e.example/f.jpg")]),
        ('<video poster="/p.jpg" src="/v.mp4">old browser</video>', [("image", "https://e.example/p.jpg"), ("video", "https://e.example/v.mp4")]),
        ('<noscript><img src="/lazy.jpg">text</noscript>', [("image", "https://e.example/lazy.jpg")]),
        ('<video><source src="/a.webm"><source src="/b.mp4"></video>', [("video", "https://e.example/a.webm")]),
    ],
)
def test_where_media_stand(html, want):
    assert [(p["kind"], p["url"]) for p in media.read_page(html, "https://e.example/x")[0]] == want


def test_generated_pages_against_what_was_written(spark):
    """Pages with text, figures, data URIs and references by digest, whose sequences are known."""
    rng = random.Random(41)
    pages, want, store = [], {}, {}
    for i in range(60):
        html, parts = "<html><head><title>t</title></head><body><nav>menu</nav>", []
        for _ in range(rng.randint(0, 12)):
            kind = rng.randrange(4)
            if kind == 0:
                text = prose(rng, rng.randint(1, 30))
                html += f"<p>{text}</p>"
                parts.append(("text", text, None, None, None))
            elif kind == 1:
                raw = bytes(rng.randrange(256) for _ in range(rng.randint(0, 40)))
                html += f'<img alt="x" src="data:image/png;base64,{base64.b64encode(raw).decode()}">'
                parts.append(("image", None, "x", len(raw), True))
            else:
                digest = hashlib.sha256(str(rng.randrange(20)).encode()).hexdigest()
                if int(digest, 16) % 3 and kind == 2:
                    store[digest] = digest[:9].encode()
                caption = prose(rng, 3)
                html += f'<figure><img src="https://cdn.example/{digest}.png"><figcaption>{caption}</figcaption></figure>'
                parts.append(("image", None, caption, digest, None))
        pages.append((i, f"https://e.example/{i}", html + "</body></html>"))
        want[i] = parts
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    held = media.embedded_payloads(df).unionByName(spark.createDataFrame([(d, "image/png", bytearray(b)) for d, b in store.items()], "digest string, mime string, payload binary"))
    for payloads in (None, held):
        known = {} if payloads is None else {d: len(b) for d, b in store.items()}
        for r in media.interleave(df, payloads).collect():
            got = [(p.kind, p.text, p.caption, p.payload_bytes, p.resolved) for p in r.parts]
            assert [p.position for p in r.parts] == list(range(len(r.parts)))
            assert got == [(k, t, c, known.get(n) if isinstance(n, str) else n, n in known if isinstance(n, str) else ok) for k, t, c, n, ok in want[r.page_id]]
