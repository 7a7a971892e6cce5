import random
import re
from functools import reduce
from urllib.parse import quote_plus, unquote

from shopmill.functions import brands, prices, text, urls, variants

LETTERS = [*"aZ0 9.,!?-/éÜß中文½́😀_ \t\n:;'\"$*&()<>{}=%", " ", " ", "Read more", "return", "//"]


def random_texts(seed, n=400, size=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_search_url_quotes_like_a_form(values):
    terms = ["apple", " gaming mouse", "a+b & c~*é", "100%", "日本"]
    assert values(urls.search_url, terms) == [
        f"https://www.amazon.com/s?k={quote_plus(t)}&s=exact-aware-popularity-rank&language=en_US&currency=USD"
        for t in terms
    ]


def test_percent_decode_keeps_plus_and_bad_escapes(values):
    texts = ["a%20b", "a+b", "%zz%41%", "%E4%BD%A0", "100%", "%2B"]
    assert values(urls.percent_decode, texts) == [unquote(t) for t in texts]


def test_categories(values):
    found = values(urls.category_from_search_url, ["x/s?k=a+b%2Bc&s=1", "x/s?q=1", "x?k=%E4%BD%A0&k=2"])
    assert found == ["a b c", "Search_Results", "你"]
    found = values(urls.category_from_bestseller_url, ["x/Best-Sellers-A-B%26/zgbs/1", "x/Best-Sellers/zgbs", None])
    assert found == ["A-B&", None, None]


def test_asin_hosts_and_file_names(values):
    assert values(urls.extract_asin, ["/x/dp/B00ABC1234/ref", "/dp/b00abc1234", "/dp/B00", None]) == [
        "B00ABC1234", None, None, None,
    ]
    assert values(urls.rewrite_host, ["https://www.amazon.co.uk/dp/1?u=amazon.cn"]) == [
        "https://www.amazon.com/dp/1?u=amazon.com"
    ]
    assert values(urls.safe_file_name, ['a<b>:"/\\|?*c']) == ["a_b________c"]
    assert values(urls.is_redirected, ["https://x.example", "https://amazon.com/gp/switch-language/1", "amazon.com"]) == [
        True, True, False,
    ]


def test_price_parse(values):
    found = values(prices.parse_price, ["$1,299.00", " $ 5 . 5 ", "12.", "ask", "", None, "2.675", "9" * 20])
    assert [None if p is None else str(p) for p in found] == [
        "1299.00", "5.50", "12.00", None, None, None, "2.68", None,
    ]
    found = values(prices.price_in_source, ['{"price": "$12.5"}', '"price":7, "price":8', '"price": none'])
    assert [None if p is None else str(p) for p in found] == ["12.50", "7.00", None]


def test_rating_and_review_count(values):
    assert values(prices.rating_from_class, ["a a-star-4-5 b", "a-star-3", "a-star", None]) == [4.5, 3.0, None, None]
    assert values(prices.rating_from_text, ["4.5 out of 5 stars", "4.5.1 out of 5", "none"]) == [4.5, None, None]
    texts = ["1,234,567 ratings", "12 global ratings", "5 stars\n7 rating", "no", "3 a 4 b ratings", "1," * 5000 + "x"]
    assert values(prices.review_count, texts) == [1234567, 12, 7, None, 4, None]


# The cleaning patterns in Python's dialect.
CLEANING = [
    (r"\s+", " "),
    (r"""[^\w\s.,;:!?()'"\-–—/\n]""", ""),
    (r"([.,!?])\1+", r"\1"),
    (r"([.!?])\s*(\w)", r"\1\n\2"),
    *((f"(?i){phrase}", "") for phrase in text.BOILERPLATE),
]


def python_clean(t):
    return reduce(lambda cleaned, rule: re.sub(*rule, cleaned), CLEANING, t.strip()).strip() or None


def test_clean_text_agrees_with_python(values):
    texts = random_texts(1) + ["Scroll left/right to see more", "a!!! b ...c", "size 5.5", "  ", "SEE MORE x"]
    assert values(text.clean_text, texts) == [python_clean(t) for t in texts]


def test_filter_code(values):
    texts = [
        "keep // drop\n\n  next ", "<script>a\nb</script>x", "<SCRIPT>f</SCRIPT>", "no return", "var x = 1 left",
        "a /* b\nc */ d", "f .cls { x } g", "plain; text", "let me", "outlet store", "", None,
    ]
    assert values(text.filter_code, texts) == [
        "keep\nnext", "x", None, None, "1 left", "a  d", "f  g", None, None, None, None, None,
    ]


def test_truncate_text(values):
    texts = ["short", "aa. bb\n\ncc. dd ee", "aa. bb. cc dddd", "aaaaaaaaaaaaaaaa", ". aaaaaaaaaaaaa", "abc! defg? hijkl"]
    assert values(lambda c: text.truncate_text(c, 12), texts) == [
        "short", "aa. bb", "aa. bb.", "aaaaaaaaaaaa", ". aaaaaaaaaa", "abc!",
    ]


def test_truncate_agrees_with_python(values):
    def shorten(t, limit=10):
        parts = (t[:limit].rpartition(separator) for separator in ["\n\n", ". ", "! ", "? "])
        cut = next((before + separator for before, separator, _ in parts if before), t[:limit])
        return t if len(t) <= limit else cut.strip()

    texts = random_texts(2) + ["a.\n\nb. c! d? eee fff", "\n\nabcdefghijklmn"]
    assert values(lambda c: text.truncate_text(c, 10), texts) == [shorten(t) for t in texts]


def test_short_description(values):
    long = "word " * 30
    assert values(text.short_description, ["<b>x</b> y", long, "a" * 120, None]) == [
        "x y", ("word " * 19).strip() + "...", "a" * 100 + "...", "",
    ]


def test_brands(values):
    assert values(brands.brand_from_byline, ["Visit the Acme Acme! Store", "Brand: (Foo) bar", " Store ", None]) == [
        "Acme", "Foo bar", None, None,
    ]
    assert values(brands.brand_from_link, ["/stores/o'neil-smith-co/page", "/x", None]) == ["O'Neil Smith Co", None, None]
    assert values(brands.brand_from_title, ["Nike shoe", "A shoe", "  (Puma) x", "", None]) == [
        "Nike", None, "Puma", None, None,
    ]


def test_sizes_and_colors(values):
    assert values(variants.sizes, ["Size: S, M, XL", "Size: Small", "Sizes: M", "Available size 5, 5.5 cm", "none", None]) == [
        ["M", "S", "XL"], ["S", "Small"], ["s"], ["5", "5.5"], [], [],
    ]
    assert values(variants.colors, ["Color: Red, Navy Blue.", "Colorful dress.", "Colours: a,, b.", "Color: 12", None]) == [
        ["Navy Blue", "Red"], ["ful dress"], [], [], [],
    ]


# The greedy forms of the colour and size patterns.
COLOR = r"((?:[A-Za-z]+(?:\s+[A-Za-z]+)*(?:\s*,\s*[A-Za-z]+(?:\s+[A-Za-z]+)*)*))(?:\.|$|\n)"
SIZE = "X?S|X?M|X?L|XXL|XXXL|2XL|3XL|4XL|5XL"


def test_sizes_and_colors_agree_with_greedy_patterns(values):
    rng = random.Random(3)
    words = ["Color", "colours:", "Available ", "color ", " ", ",", ", ", "red", "Blue", ".", "\n", "5", "s", "é", "Size: ",
             "S", "XL", "xxl", "2XL", "sizes", "Small", "x-large", "5.5", " cm"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(1500)]

    def items(t, patterns):
        found = [m for p in patterns for m in re.findall(p, t, re.I)]
        return sorted({x.strip() for m in found for x in m.split(",")})

    color_patterns = [r"Colou?rs?:?\s*" + COLOR, r"Available colou?rs?:?\s*" + COLOR]
    number, word = r"\d+(?:\.\d+)?", "Small|Medium|Large|X-Large|XX-Large"
    size_patterns = [
        rf"Size:?\s*((?:{SIZE})(?:\s*,\s*(?:{SIZE}))*)",
        rf"Available sizes?:?\s*({number}(?:\s*,\s*{number})*)",
        rf"Sizes?(?:\s+available)?:?\s*((?:{word})(?:\s*,\s*(?:{word}))*)",
    ]
    assert values(variants.colors, texts) == [items(t, color_patterns) for t in texts]
    assert values(variants.sizes, texts) == [items(t, size_patterns) for t in texts]


def test_long_lists_do_not_exhaust_the_stack(values):
    n = 20000
    sizes = "Size: " + ", ".join(["S", "M"] * n)
    numbers = "Available sizes: " + ", ".join(str(i) for i in range(n))
    assert [len(x) for x in values(variants.sizes, [sizes, numbers])] == [2, n + 1]
    colors = "Color: " + ", ".join(["red", "navy blue"] * n) + "."
    assert values(variants.colors, [colors]) == [["navy blue", "red"]]
    assert values(text.clean_text, ["word. " * n])[0].count("\n") == n - 1
    assert values(text.filter_code, ["/*" + "x\n" * n + "*/ok"]) == ["ok"]


def test_review_count_of_any_number_of_digit_groups(values):
    texts = ["1," + "0," * 31 + "7 ratings", "1," * 40_000 + "7 ratings", "1," * 400_000 + "x", "1,234 ratings", "1,2,x 5 global ratings"]
    assert values(prices.review_count, texts) == [None, None, None, 1234, 5]
