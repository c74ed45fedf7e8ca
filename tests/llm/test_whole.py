"""Cases in which an operator once did less than the whole job."""

import pytest

from cadenza.llm import html_text, licenses, mpeg_audio


@pytest.mark.parametrize("units", [3, 14, 28, 33])
def test_media_with_tag_bytes_in_the_payload(units):
    size = units * 64
    for back in range(3, min(size, 200)):
        body = bytearray(b"x" * size)
        body[size - back : size - back + 3] = b"TAG"
        stream = mpeg_audio.write(bytes(body))
        audio = mpeg_audio.parse(stream)
        assert mpeg_audio.payload_of(stream, audio) == bytes(body) and audio.skipped == 0 and set(audio.tags) == {"TSSE"}
        tagged = stream + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
        audio = mpeg_audio.parse(tagged)
        assert mpeg_audio.payload_of(tagged, audio) == bytes(body) and audio.tags["TIT2"] == "Song"


def test_tag_bytes_after_lost_sync():
    body = bytearray(b"x" * (28 * 64))
    body[-88:-85] = b"TAG"
    stream = mpeg_audio.write(bytes(body))
    begin = stream.index(b"\xff\xfb")
    cut = begin + 192 + 960
    noisy = stream[:cut] + b"garbage!" + stream[cut:]
    audio = mpeg_audio.parse(noisy)
    assert mpeg_audio.payload_of(noisy, audio) == bytes(body) and audio.skipped == 8


@pytest.mark.parametrize("n", [5, 20, 40, 400])
def test_html_long_articles_keep_headline_and_lead(n):
    body = "".join(f"<p>{'Some words, and more. ' * 14}{k}</p>" for k in range(n))
    page = f"<html><body><div><h1>The headline</h1><p class=lead>The lead, in short.</p><div>{body}</div></div></body></html>"
    assert html_text.main_text(page).split("\n")[:2] == ["The headline", "The lead, in short."] and html_text.main_text(page).count("\n") == n + 1


def test_html_sibling_articles_and_named_parts():
    one, two = ("<article><p>" + "First words, and more. " * 40 + "</p></article>", "<article><p>Second words, a few.</p></article>")
    got = html_text.main_text(f"<body><nav><p>Not this, here.</p></nav>{one}{two}</body>")
    assert "Second words" in got and "First words" in got and "Not this" not in got
    page = """<body><div class="search"><p>Find it, here.</p></div><article><h1>Title</h1><p id="legal">Legal words, first.</p><section id="discussion"><h2 id="related-work">Related work</h2><p>We discuss it, at length.</p></section>
    <div class="comments"><p>A reader, on it.</p></div></article></body>"""
    assert html_text.main_text(page) == "Title\nLegal words, first.\nRelated work\nWe discuss it, at length."
    assert html_text.main_text(page.replace("article>", "div>")) == "Title\nLegal words, first.\nRelated work\nWe discuss it, at length."


def test_licenses_in_windows(spark):
    mit = dict(licenses.FULL_TEXTS)["MIT"].split(" ")
    wrapped = "\n".join(" ".join(mit[k : k + 12]) for k in range(0, len(mit), 12))
    filler = "\n".join(f"Line {k} says a thing or two about nothing much at all." for k in range(30))
    rows = [
        (1, "See the docs. Licensed under the Apache License, Version 2.0. All contributions welcome here."),
        (2, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped),
        (3, filler + "\n" + wrapped + "\n" + filler),
        (4, "Intro words here.\nThis work is licensed under\nthe GNU General Public License,\nversion 3.\nThe end of the words, and more words yet to come in it."),
        (5, "One. Released under the MIT License. Two words. Licensed under the BSD 2-Clause License. Three."),
        (6, filler + "\n" + dict(licenses.FULL_TEXTS)["BSD-3-Clause"] + "\n" + filler),
        (7, filler + " " + dict(licenses.FULL_TEXTS)["BSD-2-Clause"] + "\n" + dict(licenses.FULL_TEXTS)["ISC"] + " More."),
        (8, filler),
    ]
    got = {r["doc_id"]: [(m["passage"], m["license"]) for m in r["matches"]] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [(1, "Apache-2.0")] and got[2] == [(5, "MIT")] and got[3] == [(31, "MIT")] and got[4] == [(2, "GPL-3.0-only")]
    assert got[5] == [(1, "BSD-2-Clause"), (1, "MIT")] and got[6] == [(31, "BSD-3-Clause")] and got[7] == [(30, "BSD-2-Clause"), (31, "ISC")] and got[8] == []
