from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from bazaarlens.llm import chat, queries, url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))


def test_rules_on_the_table(spark, data_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op5_redirect_equivalence(spark, data_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        _, rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


PAGES = "page_id long, url string, html string, host string, node string, rule string"


def judge(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], PAGES)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.RULES, **options).collect()}


def link(target):
    return f'<head><LINK href="{target}" media=x rel="canonical"></head>'


def test_blocks_reach_aliases_and_allows_come_first(spark):
    refresh = '<meta http-equiv="Refresh" content="5; URL=http://c.org/next?x=1">'
    rows = [
        (1, "http://a.net/fr/x", None),  # blocked by a rule
        (2, "https://b.org/start", link("http://a.net/fr/x#part")),  # alias of 1
        (3, "http://c.org/next?x=1#top", link("//b.org/start")),  # alias of 2
        (4, "http://d.org/", refresh),  # alias of 3
        (5, "http://e.org/one", link("/two")),
        (6, "http://e.org/two", link("http://shop.com/")),  # an alias is allowed by a rule
        (7, "http://f.net/es/y", link("http://e.org/one")),  # own rule, and its block does not beat the allow
        (8, "http://g.org/q", '<a href="http://a.net/fr/x">no alias</a>'),
        (9, "http://h.org/dir/page", link("other")),
        (10, "http://h.org/dir/other", link("http://blocked.example.com/en/z?a=1&amp;b=2")),
        (11, None, link("http://a.net/fr/x")),
        (12, "no scheme", link("http://a.net/fr/x")),
        (12, "no scheme", None),
        (13, "HTTP://WWW.Example.COM?q=http://x", ""),
    ]
    got = judge(spark, rows)
    assert [got[i][3] for i in range(1, 11)] == ["block", "block", "block", "block", "allow", "allow", "block", "allow", "block", "block"]
    assert got[11] == got[12] == ("", "", None, "allow") and got[13] == ("www.example.com", "", None, "allow")
    assert got[2][2] is None and got[1][2] == "net/fr/"


def test_redirect_tables_and_long_chains(spark):
    chain = spark.createDataFrame([(f"http://n{i}.org/", f"http://n{i + 1}.org/") for i in range(40)] + [("http://n40.org/", "http://x.net/es/")], "src string, dst string")
    got = judge(spark, [(i, f"http://n{i}.org/", None) for i in range(41)] + [(99, "http://other.org/", None)], redirects=chain)
    assert all(got[i][3] == "block" for i in range(41)) and got[99][3] == "allow"


def test_longest_rule_and_no_pages(spark):
    got = judge(spark, [(1, "http://www.example.com/en/a", ""), (2, "http://a.example.com/en/", ""), (3, "http://example.com/en", ""), (4, "http://notexample.com/en/", "")])
    assert [got[i][2:] for i in (1, 2, 3, 4)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("com/", "allow")]
    assert judge(spark, []) == {}
    with pytest.raises(ValueError):
        url_filter.matched_rule(None, None, [("a", "/", "allow")] * 10_001)


def test_the_plan_is_native(spark, data_dir):
    plan = queries.op5_redirect_equivalence(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PIECES = st.sampled_from([*chat.CONTROL, chat.ESCAPE, "<", "s>", "/s>", "[", "INST]", "a", "é", "界", "\n", "|end|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    (out,) = chat.escaped(pa.array([text], pa.large_string())).to_pylist()
    assert not any(word in out for word in chat.CONTROL)
    assert chat.unescaped(out) == text


def expected(rows):
    conversations = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        conversations.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in conversations.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_conversations_of_the_table(spark, data_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    assert found(queries.op8_chat_format(spark, data_dir)) == expected(rows)


@pytest.mark.parametrize("batch_rows,batch_bytes", [(1, 1), (3, 50), (10_000, 128 << 20)])
def test_odd_conversations_in_any_batch_size(spark, monkeypatch, batch_rows, batch_bytes):
    monkeypatch.setattr(chat, "BATCH_BYTES", batch_bytes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "</s>"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "assistant", "b")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "x⁠"), (3, None, "tool<|text|>\n", "y"), (4, 0, "assistant", "long 界 " * 60_000)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} <|end|>") for i in range(50)]
    try:
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS loss", "'y' AS formatted")
        formatted = chat.format_conversations(turns)
        assert found(chat.read_back(formatted)) == expected(rows)
        for r in formatted.collect():
            raw = r.formatted.encode()
            assert all(raw[s.start - len(chat.TEXT) : s.start] == chat.TEXT.encode() for s in r.loss)
        assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
