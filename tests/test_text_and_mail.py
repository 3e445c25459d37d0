import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from labelflow.functions import fingerprints, mail, text


def run(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


@pytest.mark.parametrize("strip", [text.strip_html, text.strip_html_parsed])
def test_visible_text(spark, strip):
    got = run(spark, strip, "<p>Hello <b>world</b></p>", "", None, "<style>x{}</style><script>var t='</p>';</script><p>a</p>", "a<!-- no -->b", '<img src="data:image/png;base64,AAAA">x', "<p>one</p>\n\n  <p>two</p>", "Fish &amp; chips")
    assert got == ["Hello world", "", "", "a", "a b", "x", "one\ntwo", "Fish & chips"]


def test_cap_and_note(spark):
    big = "<span>" * 50_000
    assert run(spark, text.html_cap_note, "short", big, 'x<img src="data:image/png;base64,' + "A" * 5000 + '">') == [None, "html 292KB -> 195KB before parse", "html 4KB -> 0KB before parse"]


def test_quotes_forwards_signatures(spark):
    assert run(spark, text.remove_quoted_replies, "My reply\n> Original message\n> continues", "Yes\n\nOn Mon, Jan 1, 2025, John wrote:\n> x", "On we go", "a\n\n \n", "", "> all") == ["My reply", "Yes", "On we go", "a", "", ""]
    assert run(spark, text.remove_forwarded, "FYI see below\n\n---------- Forwarded message ----------\nFrom: x", "none  \n", "-- Forwarded message --") == ["FYI see below", "none", "-- Forwarded message --"]
    assert run(spark, text.trim_signature, "Main content\n\n-- \nJohn Doe", "Hi\nSent from my iPhone", "a\nSent from my iPad\n--\nb", "none ", "--") == ["Main content", "Hi", "a\nSent from my iPad", "none ", ""]


def test_many_blank_lines_do_not_stall(spark):
    assert run(spark, text.remove_quoted_replies, "\n" * 20_000 + "x") == ["\n" * 20_000 + "x"]


def test_words_and_lines(spark):
    assert run(spark, text.truncate_words, "a  b\tc", " ".join(map(str, range(500)))) == ["a  b\tc", " ".join(map(str, range(400)))]
    assert run(spark, text.truncate_line, "x" * 130, "x" * 131) == ["x" * 130, "x" * 124 + " [...]"]
    assert run(spark, lambda c: F.array_join(text.lines(c), "|"), "a\r\nb\x0bc\n", "", "\n") == ["a|b|c", "", ""]


def test_body_pipeline(spark):
    html = "<html><head><title>t</title></head><body><p>Hello</p>\n<p>On Mon, John wrote:</p>\n<p>&gt; old</p></body></html>"
    assert run(spark, text.normalise_body, html) == ["Hello"]


def test_representation(spark):
    rows = spark.createDataFrame([("Alice", "alice@example.com", "Q3 Planning", "Let's discuss OKRs", ""), ("", "bot@system.com", "Alert", "Server down", None), ("A", "a@b", "s", "b", "dev")], "n string, a string, s string, b string, l string")
    got = [r[0] for r in rows.select(text.text_representation(*(F.col(c) for c in "nasbl"))).collect()]
    assert got == ["Alice <alice@example.com> | Q3 Planning | Let's discuss OKRs", "<bot@system.com> | Alert | Server down", "A <a@b> | s | b | [list: dev]"]


@pytest.mark.parametrize("parse", [mail.sender, mail.sender_fast])
def test_senders(spark, parse):
    got = run(spark, parse, "John Doe <john@example.com>", "john@example.com", '"Doe, John" <john@example.com>', "<bot@system.com>", "")
    assert [tuple(r) for r in got] == [("John Doe", "john@example.com"), ("", "john@example.com"), ("Doe, John", "john@example.com"), ("", "bot@system.com"), ("", "")]


def _part(kind, body=None, parts=None):
    out = {"mimeType": kind, "body": {"data": base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")} if body is not None else {}}
    return out | ({"parts": parts} if parts else {})


def test_bodies(spark):
    plain, html = _part("text/plain", "plain"), _part("text/html", "<p>html</p>")
    trees = [plain, html, _part("multipart/alternative", None, [plain, html]), _part("multipart/mixed", None, [plain]), _part("multipart/mixed", None, [_part("multipart/alternative", None, [plain, html]), _part("application/pdf")]), {"mimeType": "multipart/mixed"}, _part("multipart/mixed", None, [plain, _part("multipart/alternative", None, [_part("text/plain", "inner")])])]
    body = mail.decode_body
    assert run(spark, body, *map(json.dumps, trees)) == ["plain", "<p>html</p>", "<p>html</p>", "plain", "<p>html</p>", "", "inner"]
    assert run(spark, body, None, "", "{", "[1]", "{}", '{"mimeType": "text/plain"}', '{"parts": null}') == [""] * 7
    nested = lambda *parts: _part("multipart/mixed", None, list(parts))
    # The last HTML part counts, and multiparts before it don't; an empty one lets those after it speak.
    assert run(spark, body, *map(json.dumps, [nested(html, nested(_part("text/html", "in")), _part("text/html", "last")), nested(nested(html), _part("text/html", ""), plain), nested(_part("text/html", ""), nested(plain), nested(html)), nested(plain, _part("text/plain", "later"))])) == ["last", "plain", "plain", "later"]


@pytest.mark.parametrize("seed", range(3))
def test_bodies_of_random_trees(spark, seed):
    """Against a flat statement of the rule: of all leaves, in the order of their places' keys, the first with text."""
    rng = random.Random(seed)

    def tree(depth):
        if depth == 0 or rng.random() < 0.4:
            return _part(rng.choice(["text/plain", "text/html", "application/pdf"]), rng.choice(["", f"t{rng.random()}"]))
        return _part(rng.choice(["multipart/mixed", "message/rfc822"]), None, [tree(depth - 1) for _ in range(rng.randint(0, 4))])

    def leaves(node, key):
        parts = node.get("parts", [])
        of = lambda kind: [i for i, p in enumerate(parts) if p["mimeType"] == kind]
        html, plain = of("text/html")[-1:], of("text/plain")[-1:]
        yield from ((key + ((0, i),), parts[i]) for i in html)
        yield from ((key + ((2, i),), parts[i]) for i in plain)
        for i, p in enumerate(parts):
            if p["mimeType"].startswith("multipart/") and i > max(html, default=-1):
                yield from leaves(p, key + ((1, i),))

    trees = [_part("multipart/x", None, [tree(4) for _ in range(rng.randint(0, 5))]) for _ in range(60)]
    want = [next((d for _, p in sorted(leaves(t, ()), key=lambda kv: kv[0]) if (d := base64.urlsafe_b64decode(p["body"]["data"] + "==").decode())), "") for t in trees]
    assert run(spark, mail.decode_body, *map(json.dumps, trees)) == want and any(want)
    deep = _part("text/plain", "x")
    for _ in range(14):
        deep = _part("multipart/mixed", None, [deep])
    with pytest.raises(Exception, match="levels"):
        run(spark, mail.decode_body, json.dumps(deep))


def test_messages_and_headers(spark):
    raw = spark.createDataFrame([("m", None, [("FROM", "A <a@b>"), ("Subject", "one"), ("subject", "two"), ("List-Id", "<dev.lists>")], json.dumps(_part("text/plain", "hi")))], "id string, labelIds array<string>, headers array<struct<name:string,value:string>>, payload string")
    r = mail.parse_messages(raw).first()
    assert (r["subject"], r["from_name"], r["from_address"], r["body_html"], r["labels"], r["list_id"], r["date"]) == ("two", "A", "a@b", "hi", [], "dev.lists", "")


def test_bad_bytes_and_notifications(spark):
    assert run(spark, mail.decode_base64url, base64.urlsafe_b64encode(b"\xff\xfea?").decode().rstrip("=")) == ["��a?"]
    assert [tuple(r) for r in run(spark, mail.notification, '{"emailAddress":"a@b","historyId":"7"}', "{}")] == [("a@b", "7"), ("", "")]


def test_hashes(spark):
    rows = spark.createDataFrame([(["A", "B"],), (["B", "A"],), ([" A ", "B"],), (["A", "", "  "],), (["A"],)], "n array<string>")
    h = [r[0] for r in rows.select(fingerprints.excluded_hash(F.col("n"))).collect()]
    assert h[0] == h[1] == h[2] and h[3] == h[4] != h[0] and len(h[0]) == 16
