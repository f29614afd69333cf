import pytest

from lexspark.plans.query import And, Or, Phrase, QueryTooLong, Word, check_length, parse, sanitize

a, b, c, d, x = (Word(w) for w in "abcdx")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", And((a, b))),
        ("a && b", And((a, b))),
        ("a & b", And((a, b))),
        ("a AND b", And((a, b))),
        ("a | b", Or((a, b))),
        ("a || b", Or((a, b))),
        ("a OR b", Or((a, b))),
        ("a b | c d", Or((And((a, b)), And((c, d))))),
        ('Apollo Moon Landing "Hello Earth"', And((Word("Apollo"), Word("Moon"), Word("Landing"), Phrase(("Hello", "Earth"))))),
        ("(a | b) c", And((Or((a, b)), c))),
        ("x (a) | b", Or((And((x, a)), b))),
        ("a ) b", a),
        ("", None),
        ("   ", None),
        ('"a ) b"', Phrase(("a", "b"))),
        ('"a b', Phrase(("a", "b"))),
        ("(a", a),
        ("a |", a),
        ("| a", a),
    ],
)
def test_trees(text, tree):
    assert parse(text).tree == tree


def test_or_after_a_bracket_may_bind_inside():
    assert parse("x (a) | b", nested_or=True).tree == And((x, Or((a, b))))


def test_words_keep_repeats():
    assert parse('a "b a" | c').words == ("a", "b", "a", "c")


@pytest.mark.parametrize(
    ("typed", "clean"),
    [("quick&& fox", "quick   fox"), ("quick && fox", "quick && fox"), ("#quick $fox%", " quick  fox "), ("A OR B", "a or b"), ("x(y)z", "x y z"), ("(a) b", "(a) b"), ("don't/3_", "don't/3_")],
)
def test_sanitize(typed, clean):
    assert sanitize(typed) == clean


def test_length():
    check_length("x" * 38)
    with pytest.raises(QueryTooLong):
        check_length("x" * 39)
