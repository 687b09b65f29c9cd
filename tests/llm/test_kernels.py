"""Kernels against plain Python."""

import math
import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import boilerplate, markup, mixing, neardup, residue
from docloom.llm.distinctive import adjust, log_factorial, upper_tail
from docloom.llm.kernels import MinHasher, grams, hash_words, winnow, words
from docloom.llm.sitelines import line_key


def test_words():
    assert words("Ab_c1 été, «ЁЖ» ½") == ["ab", "c1", "été", "ёж", "½"]
    assert words(None) == words("") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=60), st.lists(st.sampled_from("abcdef"), max_size=60), st.lists(st.sampled_from("xyz"), min_size=12, max_size=20))
def test_winnowing_shares_a_fingerprint_of_every_long_span(left, right, shared):
    k, window = 8, 5
    prints = []
    for side in (left + shared + right, right + shared + left):
        h = grams(hash_words(side), k)
        prints.append({int(h[p]) for p in winnow(h, window)})
    assert prints[0] & prints[1]


def test_minhash_estimates_similarity_of_long_sets():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = np.concatenate([a[:4000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    m = MinHasher(400)
    assert abs((m(a) == m(b)).mean() - 4000 / 6000) < 0.08


def test_forest_depth_keeps_recall():
    for trees in (8, 16, 32, 64):
        depth = neardup.forest_depth(trees, 12, 0.8, 0.999)
        assert depth == 1 or 1 - (1 - 0.8**depth) ** trees >= 0.999


def test_upper_tail_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        m = int(rng.integers(5, 400))
        k, n = int(rng.integers(1, m)), int(rng.integers(1, m))
        low, high = max(0, n + k - m), min(k, n)
        c = int(rng.integers(low, high + 1))
        p = Fraction(sum(comb(k, x) * comb(m - k, n - x) for x in range(c, high + 1)), comb(m, n))
        got = upper_tail(np.array([c]), np.array([k]), np.array([n]), float(m))[0]
        exact = math.log(p.numerator) - math.log(p.denominator)
        assert got == pytest.approx(exact, rel=1e-8, abs=1e-8)


def test_log_factorial():
    for x in (0, 1, 7, 8, 9, 100, 16383, 16384, 10**9):
        assert log_factorial(np.array([x]))[0] == pytest.approx(math.lgamma(x + 1), rel=1e-12, abs=1e-9)


def test_adjust_is_benjamini_hochberg():
    rng = np.random.default_rng(2)
    p = rng.uniform(size=60)
    record = np.repeat([0, 1, 5], [10, 20, 30])
    got = adjust(np.log(p), record)
    for r in (0, 1, 5):
        q = p[record == r]
        order = np.argsort(q)
        want = np.empty(len(q))
        want[order] = np.minimum.accumulate((q[order] * len(q) / np.arange(1, len(q) + 1))[::-1])[::-1]
        assert np.allclose(np.exp(got[record == r]), np.minimum(want, 1))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 120))
def test_knapsack_is_optimal(counts, budget):
    reach = {0}
    for length, n in counts.items():
        reach = {r + i * length for r in reach for i in range(n + 1) if r + i * length <= budget}
    taken = mixing.bounded_knapsack(counts, budget)
    assert sum(x * n for x, n in taken.items()) == max(reach)
    assert all(n <= counts[x] for x, n in taken.items())


@pytest.mark.parametrize("seed", range(20))
def test_fit_keeps_to_budget(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 3000): rng.randint(1, 500) for _ in range(40)}
    available = sum(x * n for x, n in counts.items())
    budget, repeats = rng.randint(1, 3 * available), rng.randint(1, 4)
    full, extra, proven = mixing.fit(counts, budget, repeats)
    got = sum(x * (full * n + extra.get(x, 0)) for x, n in counts.items())
    assert full <= repeats and all(n <= counts[x] for x, n in extra.items()) and (full < repeats or not extra)
    assert got <= budget and (got == budget or got == repeats * available)


def test_a_fill_that_is_not_the_best_says_so(monkeypatch):
    assert mixing.fit({6: 100_000, 10: 100_000}, 1_000_001, 3)[2]  # sums are even: one token must stay
    monkeypatch.setattr(mixing, "KNAPSACK_TOKENS", 16)
    monkeypatch.setattr(mixing, "WIDEST_TOKENS", 64)
    full, extra, proven = mixing.fit({50: 3, 70: 2, 1000: 1}, 199, 1)
    best = max(50 * a + 70 * b for a in range(4) for b in range(3) if 50 * a + 70 * b <= 199)
    got = sum(x * n for x, n in extra.items())
    assert full == 0 and got <= 199 and (proven is False or got == best)
    monkeypatch.setattr(mixing, "WIDEST_TOKENS", 1024)
    _, extra, proven = mixing.fit({50: 3, 70: 2, 1000: 1}, 199, 1)
    assert proven and sum(x * n for x, n in extra.items()) == best


MARKED = [
    "a <b>b</b>", "</FONT> x", "x<br/>", "a &amp; b", "a ''b'' c", "[[Page|text]]", "{{as of|x|2}}", "== Head ==", "<ref>x</ref>",
    "{| class=x", r"\textbf{a}", r"{\it a}", r"5\,\%", "``a''", r"\begin{itemize}", "a **b** c", "a __b c__ d", "*a b* c", "_a_ b", "~~a~~",
    "[t](u)", "![t](u)", "a[^5]", "[a][b]", "[x]: https://e.org", "<https://e.org/x>", r"\*a\*", "- [t](u)", "## **a**", "[https://e.org text]",
]
PLAIN = [
    "# Head", "- item", "* item with 5 * 3", "> quote", "a < b and c > d", "note [3] and Q&A", "snake_case_name here", "In x, $0 < x < 3$ holds",
    "$$ s_{a} = \\frac{1}{2} $$", "Write `<b>` or `[[x]]` here", "hasi_48: thanks", "C'est l'heure", "1. one", "[sic]", "a | b | c", "",
]


def page(*lines):
    return "\n".join(["# T", "", "_Source: https://a.example/x_", "", "_Retrieved: 2020-01-01_", "", *lines])


@pytest.mark.parametrize("line", MARKED)
def test_markup_is_found_and_cleaned(line):
    assert markup.residue_lines(page(line)) == [7]
    clean = markup.clean_markup(page("Some words before it all.", line, "And some after it."))
    assert markup.residue_lines(clean) == [] or line.startswith("{|")


@pytest.mark.parametrize("line", PLAIN)
def test_structure_is_no_residue(line):
    assert markup.residue_lines(page(line)) == []
    assert line in markup.clean_markup(page(line, "x"))


def test_code_and_comments():
    assert markup.residue_lines(page("```html", "<b>x</b>", "```", "<!-- a", "b", "-->", "c")) == [10, 11, 12]
    assert markup.residue_lines(None) == markup.residue_lines("") == []
    clean = markup.clean_markup(page("```html", "<b>x</b>", "```", r"\section{Head}", r"\item one", "<h2>Two</h2>", "<li>x</li>", "== Three =="))
    for kept in ("```html\n<b>x</b>\n```", "## Head", "- one", "## Two", "- x", "## Three"):
        assert kept in clean
    assert markup.clean_markup(None) is None and markup.clean_markup("") == ""


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        (r"\textbf{x}; then; stop", "x; then; stop"), ('<div\n class="x">hello', "hello"), ('see <a title="a>b">link</a> now', "see link now"),
        ("<p>a</p><script>var x = 1;\nif (a<b) {}</script><p>b</p>", "a\nb"), ("<script>never closed\ntext after", "never closed\ntext after"),
        ("\\begin{equation}\na^2 + b\n\\end{equation}", "$$\na^2 + b\n$$"), (r"\[ x^2 \] and \(y\)", "$$x^2$$ and $y$"),
        ("x\n<pre>\ncode &lt; y\n  z</pre>\nrest", "x\n```\n\ncode < y\n  z\n```\nrest"), ("use &lt;b&gt; here &amp; there", "use `<b>` here & there"),
        ("<ul><li>one</li><li>two</li></ul>", "- one\n- two"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a | b\nc"),
        ("- <b>x</b> y", "- x y"), ("1. <h3>x</h3>", "1. x"), ("5 < 6 and 7 > 3 AT&T &copy; 1", "5 < 6 and 7 > 3 AT&T © 1"), ("a<br> b", "a\nb"),
    ],
)
def test_clean_text_follows_the_parser(text, clean):
    assert markup.clean_markup(text) == clean


def test_regions_part_content_from_markup():
    rows = ["A sentence of plain words that goes on for a while."] * 12
    text = page(*rows, *["<div><span></span></div>"] * 12, *rows)
    got = {r[0]: r[1:] for r in markup.region_sizes(text)}
    assert got["markup"][2] >= 40 and got["content"][1] > 20 * 50 and got["markup"][1] <= 3 * 51
    assert markup.clean_markup(text).count("A sentence") == 24
    assert [r[0] for r in markup.region_sizes("one line")] == ["content"]


def test_very_long_text():
    text = page(*["word " * 50 + "<b>x</b>"] * 20_000)
    assert len(markup.residue_lines(text)) == 20_000


def test_line_key():
    assert line_key("> - ## Ab  12 c3\t") == line_key("ab 7 C99") == "ab 0 c0"


def test_site():
    assert boilerplate.site_of("https://help.big-site.example:8080/a?b") == "big-site"
    assert boilerplate.site_of("www.a.test/x") == "a" and boilerplate.site_of(None) is None and boilerplate.site_of("  ") is None


def test_wrapper_has_optional_repeated_and_slots():
    pages = [
        [(1, "welcome to §", 0, False), (2, "see alpha0 now", 0, False), (3, "see alpha1 now", 0, False), (9, "bye all", 0, False)],
        [(1, "welcome to §", 0, False), (2, "see beta now", 0, False), (8, "extra bit", 0, False), (9, "bye all", 0, False)],
        [(1, "welcome to §", 0, False), (2, "see gamma now", 0, False), (7, "extra bit", 0, False), (9, "bye all", 0, False)],
    ]
    shaped = boilerplate.shape(pages, boilerplate.fixed_words(pages), [])
    wrapper = boilerplate.infer_wrapper(shaped, boilerplate.owners(pages))
    assert wrapper.order == ["welcome to §", "see * now", "extra bit", "bye all"]
    assert wrapper.repeated == {"see * now"} and wrapper.support["extra bit"] == 2 and wrapper.support["bye all"] == 3
    assert wrapper.aligned(["bye all", "welcome to §", "extra bit", None]) == {"welcome to §", "extra bit"}


def test_streams_read_whole_lines_and_whole_words():
    text = "# T\n_Source: https://www.co-op.example/x_\n_Retrieved_\ncollect contact co-op co op\n" + "We use cookies and similar tools " + "and more " * 60
    stream = boilerplate.line_stream(text, "https://www.co-op.example/x", "co-op")
    assert stream[0] == (0, "t", 0, True) and stream[1][:3] == (4, "collect contact § §", 0)
    assert stream[2][2] == 1 and stream[2][1].startswith("#")
    assert boilerplate.line_stream(text, None, "co")[1][1] == "collect contact co-op co op"


def index(n=1000):
    return residue.Index({w: n // 2 for w in words("the of a to is this page your in on be it and go back have not")}, n)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Dear [INSERT COMPANY NAME], hello", "field"), ("pay {{ fee_amount }} now", "field"), ("x ${name} y", "field"), ("by {$name} now", "field"), ("Dear <<Customer Name>>", "field"), ("1. __COMPANY_NAME__ and", "field"), ("______ (name of firm)", "field"),
        ("Sorry, the page you were looking for does not exist.", "error"),
        ("JavaScript must be turned on for this website to work.", "script"), ("HTTP 410 Gone", "error"), ("Pellentesque habitant morbi tristique senectus et netus.", "filler"), ("TODO: product", "field"),
        ("Some text.\nPlease enable JavaScript to view this page.\nMore text.", "script"), ("404 Not Found", "error"), ("Access denied", "block"),
        ("Veniam incididunt esse nulla dolore commodo quis ullamco enim.", "filler"), ("foo bar asdf blah xxx foo", "filler"), ("Loading...", "loading"),
    ],
)
def test_residue_is_labelled(text, label):
    assert index().match(text)[0] == label


@pytest.mark.parametrize(
    "text",
    [
        "Senders use fields such as `{{first_name}}`; the field is filled.", "visitors see a page with status 404 for 5 days and the seller is told why",
        "If an error message appears during payment, the amount is returned within 3 hours.", "Parts of X use JavaScript to remember your choice; you may block scripts.",
        "Access may be denied to a member of X who received 3 warnings, and the refusal can be appealed.", "note [3] and [sic]", "", "a < b",
        "see TODO list of the agency", "Name: ________", "call __init__ first", "____ (name)",
        "Placeholder accounts, for example accounts opened only to reserve a name, are removed.",
    ],
)
def test_talk_about_residue_is_none(text):
    assert index().match(text) is None


@pytest.mark.parametrize(
    "text",
    [
        "blah blah blah blah", "asdf asdf asdf asdf", "foo bar foo bar foo bar", "Lorem ipsum dolor ipsum dolor", "A line of text.\nblah blah blah blah",
        "lorem ipsum lorem ipsum lorem ipsum lorem ipsum here",
    ],
)
def test_few_distinct_filler_words_are_read(text):
    assert index().match(text) == ("filler", 1.0)


def test_exemplars_are_a_parameter():
    own = residue.Index({}, 1000, "gone the shop has closed\nfield ⟨percent⟩")
    assert own.match("The shop has closed!") == ("gone", 1.0) and own.match("404 Not Found") is None
    assert own.match("by %NAME% now") == ("field", 1.0) and own.match("by {{ name }} now") is None


def test_no_vocabulary_of_an_empty_corpus():
    assert residue.Index({}, 0).match("404 Not Found")[0] == "error"


