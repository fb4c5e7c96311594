from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, warc

PAGES = "page_id bigint, url string, html string, payload string"


def test_pages_come_back_from_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rng = random.Random(1)
    big = "é" * 600
    rows = [(k, f"http://User@www.Host{rng.randrange(4)}.example.org:80/p/{rng.randrange(9)}?q= x#f", f"page {k} " * 200, "mine") for k in range(60)]
    rows += [(100, "http://a.example/", big, None), (101, "http://b.example/", big, None), (102, None, big, None), (None, "http://c.example/", big, None),
             (103, "http://a.example/", "small", None), (104, "http://a.example/", "small", None), (105, "http://[bad", None, None), (106, "", "", None), (107, "http://x.example/\r\nA: b", "q" * 100_000, None)]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = html == big and page != 102
        assert (r.record_type, r.refers_to) == (("revisit", 102) if revisit else ("response", None))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_repeated_rows_come_back_each(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "x" * 2000, None)] * 3 + [(0, "http://a.example/", "x" * 2000, None)], PAGES)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(0, "revisit", 1)] + [(1, "response", None)] * 3


def test_index_finds_by_binary_search_and_misses_what_is_absent(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    captures = spark.createDataFrame([(warc.surt(f"http://h{k % 7}.example/{k}"), str(k), "f", k, 1) for k in range(200)], warc.CAPTURES)
    shards = [tuple(r) for r in warc.write_index(captures, warc.make_folder(spark, "cdx")).select("first", "blocks", "directory").collect()]
    index = warc.CaptureIndex(shards)
    assert all(index.find(warc.surt(f"http://h{k % 7}.example/{k}"), str(k)) == [{"filename": "f", "offset": k, "length": 1}] for k in range(200))
    assert index.find(warc.surt("http://h1.example/zzz"), "1") == [] and index.find("", "") == []
    assert warc.surt("https://WWW.a.Example.com/x?y=1#z") == "com,example,a)/x?y=1"


@pytest.mark.parametrize("host", ["foo bar", "foo  bar.example", "a b c", "é ü", "www. x", "foo)bar"])
def test_pages_of_malformed_hosts_come_back(spark, host):
    df = spark.createDataFrame([(1, f"http://{host}/x", "one", None), (2, f"http://{host}/x y", "two", None), (3, "http://foo/x", "three", None)], PAGES)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(df).collect()) == [(1, 3), (2, 3), (3, 5)]


def test_lost_captures_are_an_error(spark, monkeypatch):
    locate = warc.locate
    monkeypatch.setattr(warc, "locate", lambda keys, shards: locate(keys.where("page <> '1'"), shards))
    with pytest.raises(RuntimeError, match="1 records read back of 2"):
        warc.round_trip(spark.createDataFrame([(1, "http://a/", "x", None), (2, "http://b/", "y", None)], PAGES)).count()


# --- chat

def parts_of(turns, template=chat.DEFAULT):
    return chat.format_conversations(turns, template)


def want(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        n, turns, said = out.setdefault(conv, [0, "", ""])
        out[conv] = [n + 1, turns + f"{role or ''}\n{text or ''}\n", said + (text or "" if role == "assistant" else "")]
    return out


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_conversations_come_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_CHARS", part)
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "b\\l<\\"), (2, 0, "system", None), (2, 2, None, "x"),
            (3, None, "assistant", ""), (3, 0, "assistant", "é🙂"), (None, 0, "user", "lost"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (4, 0, "assistant", "x" * 4000), (5, 0, "[ROLE]<s>", "odd role")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(parts_of(turns.selectExpr("*", "1 AS part", "'x' AS formatted"))).collect()}
    expected = want(rows)
    assert set(got) == set(expected)
    for conv, (n, text, said) in expected.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(parts_of(turns.limit(0))).count() == 0


def test_texts_hold_no_control_strings_and_the_mask_covers_answers(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a<s>[INST]"), (1, 1, "assistant", "b</s>c")], "conv_id bigint, turn bigint, role string, text string")
    r = parts_of(turns).first()
    assert r.formatted == "<s>[ROLE]user[/ROLE][INST]a\\ls>\\bINST][/INST]</s><s>[ROLE]assistant[/ROLE]b\\l/s>c</s>"
    assert [chat.unescape(r.formatted[s["first"] : s["end"]]) for s in r.loss] == ["b</s>c"]


def rendered(template, **env):
    out = []
    chat.compile_template(template)(env, lambda s, m: out.append((s, m)))
    return "".join(s for s, _ in out)


def test_template_language():
    assert rendered("{% if x == 'a' and not y %}A{% elif x in 'bc' %}B{% else %}C{% endif %}", x="b", y=1) == "B"
    assert rendered("{% for m in ms %}{{ m.k | upper }}{{ '-' + m.v }}{% endfor %}", ms=[{"k": "a", "v": "1"}, {"k": "b", "v": "2"}]) == "A-1B-2"
    assert rendered("{{ (a or 'none') | trim }}", a="") == "none"
    tree = chat.fold(chat.parse_template("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{% if true or y %}e{% endif %}"))
    assert tree == [("text", "abCde")]


@pytest.mark.parametrize("bad", ["{% for x of y %}{% endfor %}", "{% if x %}", "{{ x. }}", "{{ open('f') }}", "{{ x.__class__.y }}", "{{ x | eval }}", "{% endif %}", "{{ }}", "{{ a b }}"])
def test_templates_outside_the_language_fail(bad):
    with pytest.raises(chat.TemplateError):
        rendered(bad, x="s")


def test_nothing_is_left_of_python_objects():
    with pytest.raises(chat.TemplateError):
        rendered("{{ x.__class__ }}", x="s")
    assert F is not None
