import pytest

from depguard.plans.schedule import schedule
from depguard.rules import DC, DD, FD, MFD, POD, Dist, Lit, Pred, Ref, RuleError, parse_rule


def test_fd_forms():
    assert parse_rule("zip_state", "fd") == FD(("zip",), "state")
    assert parse_rule(" p_brand , p_type -> p_size ", "fd") == FD(("p_brand", "p_type"), "p_size")
    assert parse_rule("a->b,c", "fdset").rules == (FD(("a",), "b"), FD(("a",), "c"))
    with pytest.raises(RuleError):
        parse_rule("a->b;b->c", "fd")
    with pytest.raises(RuleError):
        parse_rule("zip", "fd")


def test_mfd():
    assert parse_rule("zip,city@fname", "mfd") == MFD(("zip", "city"), "fname")


def test_dc_operators_and_sides():
    dc = parse_rule("A.city=B.city@A.zip!=B.zip@A.salary>15000", "dc")
    assert dc.preds == (Pred(Ref("A", "city"), "=", Ref("B", "city")), Pred(Ref("A", "zip"), "!=", Ref("B", "zip")), Pred(Ref("A", "salary"), ">", Lit(15000)))
    assert parse_rule("B.x<A.y", "dc").preds == (Pred(Ref("A", "y"), ">", Ref("B", "x")),)
    assert parse_rule("-1.5<=A.x@A.n='it''s'", "dc").preds == (Pred(Ref("A", "x"), ">=", Lit(-1.5)), Pred(Ref("A", "n"), "=", Lit("it's")))
    assert parse_rule("A.BAND>=1@A.`my col`<>2", "dc").preds[1] == Pred(Ref("A", "my col"), "!=", Lit(2))
    for bad in ("A.x", "A.x=1=2", "x=1", "1=2", "A.x ~ 1"):
        with pytest.raises(RuleError):
            parse_rule(bad, "dc")


def test_dd():
    dd = parse_rule("salary<10000,salary>8000@zip<10000,state>=11", "dd")
    assert dd.lhs == (Dist("salary", "<", 10000.0), Dist("salary", ">", 8000.0)) and dd.rhs[1] == Dist("state", ">=", 11.0)
    assert parse_rule("10000>salary@x<1", "dd").lhs == (Dist("salary", "<", 10000.0),)
    assert isinstance(dd, DD) and isinstance(parse_rule("A.x=1", "dc"), DC)


def test_pod():
    assert parse_rule("[1>][2>]->[3>]", "pod") == POD((("1", ">"), ("2", ">")), ("3", ">"))
    assert str(parse_rule("[a1>][a2>=]->[c<]", "pod")) == "[a1>][a2>=]->[c<]"


def test_schedule():
    order = lambda text: schedule(list(parse_rule(text, "fdset").rules))
    got, left = order("plant,line->shift;shift,badge->crew;crew,hall->lead;badge->shift;hall->crew")
    assert [(y, len(rs)) for y, rs in got] == [("shift", 2), ("crew", 2), ("lead", 1)] and not left
    got, left = order("hue->tint;size->cut;tint,cut->price")
    assert {y for y, _ in got[:2]} == {"tint", "cut"} and got[2][0] == "price" and not left
    assert [y for y, _ in order("a->b;b->c")[0]] == ["b", "c"]
    assert order("a->b;b->a") == ([], ["b", "a"])
    assert sorted(order("x->a;a->b;b->a")[1]) == ["a", "b"]
