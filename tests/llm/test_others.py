"""HTML extraction, top-k search, chat formatting, license scans and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.llm import chat, html, licenses, queries, topk

from . import helpers as h

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
<header><p>Site, name, slogan</p></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class="cookie-notice">We use cookies, yes, many.</div>
<div id="wrap"><div class="post"><h1>Head &amp; line</h1><p>First  paragraph,
 with <b>bold</b> text, commas, and a length that makes it look like prose to any reader.<p>Second&nbsp;one, shorter.<br>After the break.
<ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b<tr><td>cell c</table></div><aside>More, more, more</aside><div class="sidebar"><p>Side, bar, text</p></div></div>
<form><p>Sign, up, now</p><input></form><section id="comments"><p>I, too, have, many, commas, to, give, here, and, a, long, comment, about, this.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line First paragraph, with bold text, commas, and a length that makes it look like prose to any reader. Second one, shorter. After the break. item one item two cell a cell b cell c"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("</div><p>x &bogus; &#65;", "x &bogus; A"), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"), ("<article><p>" + "long text, " * 20_000 + "</p></article>", ("long text, " * 20_000).strip()), ("<script>alert(1)", "")])
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


def test_html_query(spark, sf_dir):
    rows = queries.op4_html(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text
        assert r.text == html.main_text(pages[r.page_id])


def brute_top(rows, k):
    dim = max((len(v) for _, v in rows if v), default=1)
    ok = [(i, np.pad(np.floor(64 * np.array(v, dtype=float)), (0, dim - len(v)))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in ok:
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("limits", [(4096, 4096), (16, 3)])
def test_top_k_is_exact(spark, monkeypatch, limits):
    """Clusters, repeats, odd vectors; small blocks split hot rings and cut queries into chunks."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", limits[0])
    monkeypatch.setattr(topk, "QUERY_ROWS", limits[1])
    topk.Rings.__init__.__defaults__ = (limits[0],)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centers[rng.integers(6)] + 0.1 * rng.normal(size=8)]) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]
    rows += [(400, None), (401, []), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7), (480, [0.0] * 8), (500, [1.0, 2.0]), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, "vec_id", k=20)
    assert {tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()} == brute_top(rows, 20)
    few = frame.where("vec_id < 5")
    assert {tuple(r) for r in topk.top_k(few, topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, "vec_id").select("query_id", "rank", "id", "score").collect()} == brute_top(rows[:5], 20)
    assert topk.top_k(frame.limit(0), topk.scaled(F.col("embedding")), F.lit(True), "vec_id").count() == 0


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "\\", "<\\|end|>\n", "a\\<|end|>", "", None, "é中🙂\r\n", "<s><<SYS>>x<</SYS>>", "<|im_start|><|endoftext|><"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|end|>\n"]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (50, None, "assistant", "y"), (50, 1, "assistant", "z"), (50, 1, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.records_of_rows(table), ["messages"]))
    out = out.select("conv_id", "turns", "formatted", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        want = sorted(((x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.back] == [(x[3], x[5]) for x in want]
        assert r.loss == "".join(x[5] for x in want if x[3] == "assistant")
    assert len(out) == 42
    assert chat.records_of_rows(table.limit(0)).count() == 0


def test_layouts_are_told_apart_by_their_fields(spark):
    js = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","input":"i","output":"a"}', '{"instruction":"q","output":"a"}', '{"system":"s","prompt":"q","response":"a"}', '{"prompt":"q","completion":"a"}', '{"unknown":1}', "broken"]
    frame = spark.createDataFrame([(i, j) for i, j in enumerate(js)], "n int, js string")
    fields = [f.name for f in chat.RECORD.fields]
    got = {r.n: (r.layout, [(t.role, t.text) for t in r.turns] if r.turns is not None else None) for r in chat.canonical_turns(chat.parse_records(frame, "js"), fields).collect()}
    pair = [("user", "q"), ("assistant", "a")]
    assert got == {0: ("messages", pair), 1: ("conversations", pair), 2: ("instruction_input_output", [("user", "q\n\ni"), ("assistant", "a")]), 3: ("instruction_output", pair), 4: ("system_prompt_response", [("system", "s"), *pair]), 5: ("prompt_completion", pair), 6: (None, None), 7: (None, None)}


def brute_cosine(a, b, idf, rare):
    from collections import Counter

    def vec(text):
        w = licenses._WORD.findall(text.lower())
        c = Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:])])
        return {t: n * idf.get(t, rare) for t, n in c.items()}

    x, y = vec(a), vec(b)
    return sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_license_cosine_and_skipping():
    t = licenses.Templates()
    lines = [x for _, x in licenses.TEMPLATES] + ["Licensed under the Apache License, version 2.0, please", "we all rights are the of in", "See the MIT license here", "all all all", "no license words"]
    for line in lines:
        want = max((round(brute_cosine(line, x, t.idf, t.rare), 9), n) for n, x in licenses.TEMPLATES)[0]
        name, score, at, share = t.scan("before\n" + line + "\nafter")
        assert (score if name else 0) == pytest.approx(want if want >= t.threshold else 0)


def test_license_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit), ("a/x.py", "code"), ("a/b/COPYING", apache), ("a/b/c/d/y.py", "code\nmore"), ("a/b/z.py", f"words\n{mit}\nwords"), ("q.py", None), (None, "code"), ("a/x.py", "code"), ("e/w.py", "")]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "n int, path string, text string")
    got = {r.n: (r.license, r.effective, r.inherited_from) for r in licenses.scan_licenses(files, "text", "path").collect()}
    assert got == {0: ("MIT", "MIT", None), 1: (None, "MIT", ""), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "Apache-2.0", "a/b"), 4: ("MIT", "MIT", None), 5: (None, "MIT", ""), 6: (None, None, None), 7: (None, "MIT", ""), 8: (None, "MIT", "")}
    assert licenses.scan_licenses(files.limit(0), "text", "path").count() == 0


def test_license_query_keeps_every_document(spark, sf_dir):
    rows = queries.op10_licenses(spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        lines = docs[r.doc_id].split("\n")
        assert (r.license is not None) == any(x in lines for x in ("All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."))


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
