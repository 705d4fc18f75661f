"""The chat template language, its sandbox, and the round trip of formatted conversations."""

import hashlib
import random

import pytest

from tidewatch.llm import chat, chat_format
from tidewatch.llm.chat import Const, Put, TemplateError, compile_template, fold_all, guard, parse, unguard

FILTERS = {"up": str.upper, "guard": guard(("###",))}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, learned string, conv string"


def render(template, **scope):
    return "".join(text for text, _ in compile_template(template, FILTERS)(scope))


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("plain", "plain"), ("", ""), ("{{ 'a' ~ 1 ~ true }}", "a1true"), ("{{ x.y.z }}", "deep"), ("{{ x.no.z }}|{{ nothing }}", "|"),
        ("{{ 'it' | up }}{{ x.y.z | up }}", "ITDEEP"), ("{{ \"q\\\"\\n\" }}", 'q"\n'), ("{% if 1 == 1 and not false %}y{% else %}n{% endif %}", "y"),
        ("{% if none %}a{% elif x.y.z == 'deep' %}b{% else %}c{% endif %}", "b"), ("{% if none or 'v' %}a{% endif %}", "a"),
        ("{% for i in list %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "0a,1b,2c"),
        ("{% for i in none %}x{% endfor %}", ""), ("{% for i in list %}{% for j in list %}{{ i ~ j }}{% endfor %};{% endfor %}", "aaabac;babbbc;cacbcc;"),
        ("{{ (1 == 2) ~ (1 != 2) }}", "falsetrue"),
    ],
)
def test_language(template, want):
    assert render(template, x={"y": {"z": "deep"}}, list=["a", "b", "c"]) == want


@pytest.mark.parametrize(
    "template",
    ["{% for %}", "{% for x in y %}", "{% if a %}", "{% endif %}", "{% else %}", "{{ }}", "{{ a b }}", "{{ 'open }}", "{{ a | none }}", "{{ f() }}", "{{ a[0] }}",
     "{{ 1 + 1 }}", "{% set a = 1 %}", "{{ a. }}", "{{ (a }}", "{{ and }}", "{% generation %}", "{% for x in y %}{% endif %}"],
)
def test_errors(template):
    with pytest.raises(TemplateError):
        compile_template(template, FILTERS)


def test_sandbox_shows_no_attributes_of_python_objects():
    class Thing:
        secret = "secret"

    assert render("{{ t.secret }}{{ t.__class__ }}{{ d.__class__ }}{{ d.items }}{{ s.upper }}", t=Thing(), d={"k": 1}, s="s") == ""


def test_folding():
    tree = fold_all(parse("a{{ 'b' ~ 1 }}{% if 'x' == 'x' %}c{% else %}{{ d }}{% endif %}{{ '' }}{{ 'e' | up }}{% if 1 == 2 %}f{% endif %}", FILTERS), FILTERS)
    assert tree == (Put(Const("ab1cE")),)
    (kept,) = fold_all(parse("{% if x %}{{ 'a' ~ 'b' }}{% elif 1 == 1 %}c{% elif y %}d{% endif %}", FILTERS), FILTERS)
    assert [body for _, body in kept.cases] == [(Put(Const("ab")),), (Put(Const("c")),)]


def test_generation_marks():
    pieces = list(compile_template("a{% generation %}b{% if x %}{{ x }}{% endif %}{% endgeneration %}c", FILTERS)({"x": "y"}))
    assert [(t, m) for t, m in pieces if t] == [("a", False), ("b", True), ("y", True), ("c", False)]


def test_messages_are_rendered_while_they_come():
    seen = []

    def messages():
        for i in range(5):
            seen.append(i)
            yield {"role": "user", "content": str(i)}

    pieces = compile_template("{% for m in messages %}{{ m.content }}{% endfor %}")({"messages": messages()})
    assert next(pieces) == ("0", False) and seen == [0, 1]


@pytest.mark.parametrize("text", ["", "\\", "###", "\\###\\", "####", "a </turn> b", "\\\\</turn>", "### x: </turn>\n", "é\n\\n"])
def test_escapes_round_trip(text):
    guarded = chat_format.FILTERS["guard"](text)
    assert unguard(guarded) == text
    # The string that ends a turn never stands in a text without a backslash of its own before it.
    at = guarded.find("</turn>")
    while at >= 0:
        assert (len(guarded[:at]) - len(guarded[:at].rstrip("\\"))) % 2 == 1
        at = guarded.find("</turn>", at + 1)
    pieces = compile_template(chat_format.TEMPLATE, chat_format.FILTERS)({"messages": [{"role": text, "content": text}, {"role": "assistant", "content": text}]})
    assert list(chat_format.read_turns(t for t, _ in pieces)) == [(text, text), ("assistant", text)]


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), whole, len(said), hashlib.sha256(said.encode()).hexdigest()


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_CHARS", 40)
    rnd = random.Random(3)
    bits = ["###", "</turn>", "\\", ":", "\n", "a", "é", "漢", " ### user: x</turn>\n"]
    rows = [(c, t, rnd.choice(["user", "assistant", "sys:tem", "a\\b", "###"]), "".join(rnd.choices(bits, k=rnd.randint(0, 12)))) for c in range(20) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, None, None), (None, None, "assistant", "first"), (50, 1, "b", "x"), (50, 1, "a", "y"), (50, 1, "a", "y"), (51, 0, "assistant", "long " * 30_000), (52, 0, "assistant", "")]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c)
        want[c] = digests([(r, x) for _, _, r, x in own])
    assert got == want


def test_no_conversations(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert chat_format.read_back(chat_format.format_conversations(nothing)).collect() == []


def test_other_templates_and_unread_turns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", 1, "", ""), (1, 1, "assistant", "b", 1, "", "")], SCHEMA)
    made = chat_format.format_conversations(frame, "{% for m in messages %}{{ m.role }}={% generation %}{{ m.content }}{% endgeneration %};{% endfor %}").collect()
    assert [(r["text"], [(x["start"], x["length"]) for x in r["learned"]]) for r in made] == [("user=a;assistant=b;", [(5, 1), (17, 1)])]
    with pytest.raises(ValueError):
        list(chat_format.read_turns(["### user: no end"]))
    assert chat.TemplateError.__mro__[1] is ValueError
