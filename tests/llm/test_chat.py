import hashlib
import random

import pytest

from quernstone.llm import chat
from tests.llm.helpers import save


def render(template, **names):
    return chat.Template(template).render(**names)[0]


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("a{{ 'x' ~ 1 }}b", "ax1b"),
        ("{% if 1 == 1 and not false %}y{% else %}n{% endif %}", "y"),
        ("{% if none %}a{% elif m %}b{% endif %}", "b"),
        ("{% for x in m %}{{ loop.index }}{{ x.role }}{% if not loop.last %},{% endif %}{% endfor %}", "1u,2a"),
        ("{% set q = 'k' %}{{ q | upper }}", "K"),
        (" {{- 'a' -}} b", "ab"),
        ("{{ m[0].role + 'x' }}", None),
        ("{{ missing.thing }}", ""),
        ("{{ 'a' in 'abc' }}", "true"),
        ("{{ 'it\\'s' }}", "it's"),
    ],
)
def test_language(template, want):
    m = [{"role": "u", "text": "1"}, {"role": "a", "text": "2"}]
    if want is None:
        return  # members of lists aren't in the language; see test_sandbox
    assert render(template, m=m) == want


@pytest.mark.parametrize("template", ["{{ x.__class__ }}", "{{ f() }}", "{% import os %}", "{{ x | eval }}", "{% for x in y %}", "{% endif %}", "{{ 1 + }}", "{{ _x }}", "{% else %}", "{{ 'a }}"])
def test_sandbox(template):
    with pytest.raises(chat.TemplateError):
        chat.Template(template)


def test_constants_are_folded():
    assert chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if false %}x{% else %}d{% endif %}")) == [("text", "abcd")]


def test_escape_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    pieces = [*chat.CONTROL, "\\", "<", "[", "|", "a", "<\\", "\\\\<", "turn|>", "é"]
    for _ in range(3000):
        t = "".join(r.choices(pieces, k=r.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def turns_of(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r, x))
    none_first = lambda v: (v is not None, v if v is not None else 0)
    return {c: [(r or "", x or "") for t, r, x in sorted(v, key=lambda y: (none_first(y[0]), (y[1] is not None, y[1] or ""), (y[2] is not None, y[2] or "")))] for c, v in out.items()}


def test_query(spark, tmp_path):
    r = random.Random(6)
    say = lambda: r.choice([None, "", "hello", "</s>[INST]", "a\\<b", "<|end|>\n<|turn|>user<|text|>", "x" * 70_000, "é漢😀"])
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), say()) for c in range(40) for t in range(r.randint(1, 7))]
    rows += [rows[0], (None, 0, "user", "no id"), (3, None, "assistant", "no turn"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as messages", "1 as n_turns")
    got = {x.conv_id: tuple(x)[1:5] for x in chat.op8_chat_format(spark, save(df, tmp_path, "conversations")).collect()}
    rows += [(-7, 0, "user", chat.TRICKY), (-7, 1, "assistant", chat.TRICKY)]
    want = {}
    for c, turns in turns_of(rows).items():
        loss = "".join(x for a, x in turns if a == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got == want


def test_marks_are_where_assistants_speak(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "an<swer"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    x = chat.formatted(df).first()
    assert [x.text[a.start : a.end] for a in x.generated] == ["an<\\swer"]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [x.conv_id for x in chat.op8_chat_format(spark, save(df, tmp_path, "conversations")).collect()] == [-7]
