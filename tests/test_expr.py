"""The expression compiler against pandas itself."""

import math
import random

import pandas as pd
import pytest

from linkloom import DfEval, Query, RowEval
from linkloom.plans.expr import ExpressionError

VALUES = [None, -7.0, -1.5, 0.0, 2.0, 5.0]
INTS = [-7, -3, 0, 2, 5]


@pytest.fixture(scope="module")
def both(spark):
    rows = [(i * 6 + j, f, g, INTS[i % 5], INTS[j % 5], "abc"[i % 3]) for i, f in enumerate(VALUES) for j, g in enumerate(VALUES)]
    names = ["n", "f", "g", "i", "j", "s"]
    pdf = pd.DataFrame(rows, columns=names).astype({"f": float, "g": float})
    df = spark.createDataFrame(rows, "n long, f double, g double, i long, j long, s string").persist()
    return df, pdf


CONDITIONS = [
    "f < g", "f == g", "f != g", "not (f < g)", "~(f <= g)", "f in [2, 5]", "f not in [2, 5]", "0 < f <= 5", "f > 1 & g < 3", "f > 1 | g < 3",
    "f > 0 and not g > 0 or i == 2", "i != j", "s == 'a'", "s != 'a'", "s in ['a', 'b']", "`f` >= g", "i // 2 > j", "f.isnull()", "g.notnull() and f < 0", "s.str.contains('[ab]')", "i % 2 == 1",
]
EXPRESSIONS = ["f + g", "f - g * 2", "f / g", "i / j", "f // g", "i // j", "f % g", "i ** 2", "-f", "abs(i)", "sin(f)", "exp(i)", "floor(f)", "ceil(g)", "arctan2(f, g)", "log(i)", "log10(i)", "sqrt(i)", "(i + j) * 3", "expm1(f)", "cosh(g)"]


def test_conditions(both):
    df, pdf = both
    for text in CONDITIONS:
        want = sorted(pdf.query(text).n)
        assert sorted(r.n for r in Query(text)(df).collect()) == want, text


def test_fuzzed_conditions(both):
    df, pdf = both
    rng = random.Random(5)

    def term(depth):
        if not depth or rng.random() < 0.3:
            return f"{rng.choice('fgij')} {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {rng.choice(['f', 'g', 'i', 'j', '0', '2.5', '-3'])}"
        if rng.random() < 0.25:
            return f"not ({term(depth - 1)})"
        return f"({term(depth - 1)}) {rng.choice(['and', 'or', '&', '|'])} ({term(depth - 1)})"

    for _ in range(25):
        text = term(3)
        assert sorted(r.n for r in Query(text)(df).select("n").collect()) == sorted(pdf.query(text).n), text


def test_expressions(both):
    df, pdf = both
    for text in EXPRESSIONS:
        want = dict(zip(pdf.n, pdf.eval(text, engine="python")))
        for r in DfEval(text, "out")(df).select("n", "out").collect():
            w = want[r.n]
            if w is None or w != w:
                assert r.out is None or r.out != r.out, (text, r)
            else:
                assert r.out is not None and (r.out == w or math.isclose(r.out, w, rel_tol=1e-9)), (text, r, w)


def test_assignments(both):
    df, _ = both
    out = DfEval("a = i + 1\nb = a * 2\ni = b - a")(df)
    r = out.where("n = 0").first()
    assert (r.a, r.b, r.i) == (-6, -12, -6) and out.columns == ["n", "f", "g", "i", "j", "s", "a", "b"]
    assert DfEval("i = 2 ** 3")(df).first().i == 8


def test_overflow_and_strings(both):
    df, _ = both
    assert DfEval("i * 4611686018427387904 * 4", "out")(df).where("i = 5").first().out is None
    r = RowEval("row.s + '!'", "t")(df).first()
    assert r.t == r.s + "!" and r["__error__"] is None
    assert {x.u for x in DfEval("s.str.upper()", "u")(df).collect()} == {"A", "B", "C"}
    assert DfEval("s.str.len()", "u")(df).first().u == 1


def test_rejected(both):
    df, _ = both
    for text in ("i + 1", "f if i else g", "@x > 1", "none > 1", "s < 1", "foo(f) > 1", "f >", "lambda: 1"):
        with pytest.raises(ExpressionError):
            Query(text)(df)
    for text in ("s + 'x'", "i"):
        with pytest.raises(ExpressionError):
            DfEval(text)(df) if text == "i" else DfEval(text, "o")(df)
    with pytest.raises(ExpressionError):
        RowEval("s + 'x'", "o")(df)


def test_string_arguments_are_literals(spark):
    df = spark.createDataFrame([("a", "b")], "s string, t string")
    for text in ("s.str.contains(t)", "s.str.contains()", "s.str.startswith(1)", "s.str.contains('a', case=t)"):
        with pytest.raises(ExpressionError):
            Query(text)(df)
