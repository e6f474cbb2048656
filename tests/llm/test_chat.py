"""Templates, escapes, and conversations read back from their text."""

import hashlib
import random

import pytest

from paceline.llm import chat
from paceline.llm.queries import chat_digests
from paceline.llm.template import Generation, Print, TemplateError, Text, compile_template

SCHEMA = "conv_id bigint, turn int, role string, text string, start string, piece int"


@pytest.mark.parametrize(
    ("source", "values", "wanted"),
    [
        ("plain", {}, "plain"),
        ("{{ a + 'b' | upper }}", {"a": "x"}, "xB"),
        ("{{ a.b[1] }}{{ a['b'][0] }}", {"a": {"b": ["p", "q"]}}, "qp"),
        ("{% if a == 1 and not b %}y{% elif a in 'xyz' or b %}m{% else %}n{% endif %}", {"a": 1, "b": True}, "m"),
        ("{% for x in l %}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"l": ["a", "b"]}, "0a,1b"),
        ("a {%- set x = 1 + 2 %} b{{ x % 2 }}{{- ' c' | trim }}{# no #}", {}, "a b1c"),
        ("{{ 'yes' if a else 'no' }}{{ none }}{{ 1 < 2 }}", {"a": ""}, "notrue"),
        (r"{{ 'it\'s\n' }}{{ (2 + 3) | length if false else 7 }}", {}, "it's\n7"),
        ("{{ 'a' not in l }}{{ 3 >= 3 }}{{ 'b' > 'a' }}{{ 1 != 1 }}", {"l": ["a"]}, "falsetruetruefalse"),
    ],
)
def test_language(source, values, wanted):
    assert compile_template(source).text(**values) == wanted


@pytest.mark.parametrize(
    "source",
    ["{{ a", "{% if a %}", "{% endfor %}", "{{ a() }}", "{{ | x }}", "{{ a | nothing }}", "{% for in x %}{% endfor %}", "{{ 1 + }}",
     "{% generation %}{% generation %}x{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{{ a ? b }}"],
)
def test_sources_that_are_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize(
    ("source", "values"),
    [("{{ a.__class__ }}", {"a": "x"}), ("{{ a.keys }}", {"a": {}}), ("{{ f }}", {"f": len}), ("{{ a % 0 }}", {"a": 1}), ("{{ b }}", {}),
     ("{% for c in a %}{% endfor %}", {"a": "abc"}), ("{{ a[9] }}", {"a": [1]})],
)
def test_nothing_but_the_given_values_is_reached(source, values):
    with pytest.raises(TemplateError):
        compile_template(source).text(**values)


def test_constants_are_folded():
    tree = compile_template("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{% generation %}{% endgeneration %}{{ v }}").tree
    assert tree[0] == Text("abCd") and isinstance(tree[1], Print) and len(tree) == 2
    assert compile_template("{% generation %}a{{ 1 }}{% endgeneration %}").tree == (Generation((Text("a1"),)),)


def test_loops_take_one_item_at_a_time():
    taken = []

    def items():
        for i in range(100):
            taken.append(i)
            yield i

    out = compile_template("{% for x in l %}{{ x }}{% endfor %}").render(l=items())
    assert next(out) == ("0", False) and len(taken) == 2


def hard_texts(r, n):
    signs = ["<s>", "</s>", "[INST]", "[/INST]", "<", "/", "s>", "[", "INST]", "]", "\\", ".", "n", "\n", " ", "\\.", "é", "𝒳", "ok", "[INST] ", " [/INST]"]
    return ["".join(r.choice(signs) for _ in range(r.randrange(0, 12))) for _ in range(n)]


def test_escapes_are_undone_and_hide_every_control():
    for t in hard_texts(random.Random(1), 4000):
        e = chat.escape(t)
        assert chat.unescape(e) == t and chat.unescape(chat.escape_line(t)) == t and "\n" not in chat.escape_line(t)
        assert not any(c in e for c in chat.CONTROLS)
        for c in chat.CONTROLS:
            for k in range(1, len(c)):
                assert not e.endswith(c[:k]) and not e.startswith(c[k:])


def brute(rows):
    """Digests from the rows alone, never from output."""
    convs = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    for row in sorted(rows, key=key):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    out = {}
    for conv, turns in convs.items():
        said = "".join(t for role, t in turns if role == "assistant")
        h = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), h, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def made(rows, spark):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    return {r["conv_id"]: tuple(r)[1:] for r in chat.digest(chat.render(df)).collect()}


def test_read_back_equals_the_rows(spark):
    r = random.Random(2)
    roles = ["user", "assistant", "system", "tool\nx", "</s>", "", None]
    rows = [(r.choice([None, *range(40)]), r.choice([None, 0, 1, 2, 3]), r.choice(roles), t) for t in hard_texts(r, 1500)]
    rows += [(50, 0, "assistant", None), (51, 0, None, None), (52, 5, "user", ""), (53, 0, "assistant", "x" * 3_000_000)] + [(54, 0, "assistant", "again")] * 3
    got = made(rows, spark)
    assert {k: v[:4] for k, v in got.items()} == brute(rows)
    assert all(v[4] > 0 for v in got.values())


def test_a_hot_conversation_is_a_stream(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(30_000)]
    assert {k: v[:4] for k, v in made(rows, spark).items()} == brute(rows)
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    pieces = chat.render(df).orderBy("piece").collect()
    whole = "".join(p["formatted"] for p in pieces)
    assert all(whole[p["start"] :].startswith(p["formatted"][:50]) for p in pieces[:200])
    learnt = [chat.unescape(whole[a:b]) for p in pieces for a, b in p["spans"]]
    assert learnt == [t for _, _, role, t in rows if role == "assistant"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digest(chat.render(empty)).collect() == []


def test_the_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_digests(spark, sf_dir).collect()}
    assert {k: v[:4] for k, v in got.items()} == brute(rows)
