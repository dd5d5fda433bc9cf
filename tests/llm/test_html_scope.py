"""Nothing of an article is lost but what is marked as no text."""

from attestra.llm import html_text


def test_short_passages_of_an_article_stay():
    long = "a long passage of words " * 40
    page = f'<body><article><h1>Title</h1><div class=share>tell all</div><p>{long}</p><div class="ad">buy</div><p>short end</p></article><p>outside</p>'
    assert html_text.main_text(page) == f"Title {long.strip()} short end"


def test_scope_is_a_tag_and_not_a_string():
    for noise in ("<script>var t = '<article>';</script>", "<!-- <main> -->", '<a title="<article>">x</a>'):
        assert html_text.main_text(f"<body>{noise}<div><p>All of this is text.</p></div></body>").endswith("All of this is text.")
    assert html_text.main_text("<script>'<main>'</script><p>before</p><article><p>in</p></article>") == "in"
