"""Main text of pages written by hand, in layouts and words that the labeller's training pages don't copy."""

import time

import pytest

from glossaria.llm.html_blocks import blocks
from glossaria.llm.html_extract import main_texts
from glossaria.llm.html_lstm import STRETCH, pretrained

RECIPE = (
    """<html><head><title>Plum cake</title><style>.a{}</style></head><body>
<div id="top"><a href="/"><img src="l.png" alt=""></a><ul class="nav"><li><a href="/r">Recipes</a><li><a href="/t">Techniques</a><li><a href="/s">Shop</a></ul></div>
<div class="recipe"><h1>Plum cake with almonds</h1><p>This cake keeps for a week in a tin and tastes better on the second day.</p>
<h2>Ingredients</h2><table><tr><td>Flour</td><td>250 g</td></tr><tr><td>Plums</td><td>1 kg</td></tr></table>
<h2>Method</h2><ol><li>Cream the butter with the sugar until pale.</li><li>Halve the plums and press them into the batter.</li><li>Bake for forty minutes.</li></ol></div>
<div class="newsletter"><h3>Sign up to our newsletter</h3><form><input name=e><button>Subscribe</button></form></div>
<div class="footer">&copy; 2024 The Plum Kitchen. All rights reserved.</div></body></html>""",
    ["Plum cake with almonds", "This cake keeps for a week in a tin and tastes better on the second day.", "Ingredients", "Flour", "250 g", "Plums", "1 kg", "Method", "Cream the butter with the sugar until pale.", "Halve the plums and press them into the batter.", "Bake for forty minutes."],
)
NEWS = (
    """<!doctype html><body class="page"><header class="site-header"><span>The Harbour Times</span><nav><a href=/n>News</a> <a href=/s>Sport</a> <a href=/o>Opinion</a></nav></header>
<main><article><h1>Ferry returns after two years</h1><p class="standfirst">The crossing had been closed since the storm.</p>
<figure><img src=f.jpg><figcaption>The ferry leaving the harbour on Monday.</figcaption></figure>
<p>Hundreds of people lined the quay on Monday as the ferry left for the islands for the first time in two years.</p>
<div class="ad-slot">Advertisement</div>
<p>&ldquo;We had almost given up hope,&rdquo; said Ruth Lind, who runs the bakery by the pier.</p>
<aside class="related"><h4>Related articles</h4><ul><li><a href=/a>Storm damage put at nine million</a></li><li><a href=/b>Islanders demand a bridge</a></li></ul></aside>
<p>The company expects to carry a quarter of a million passengers a year.</p></article>
<section id="comments"><h2>3 Comments</h2><div class="comment"><b>Jo</b><p>About time too, we waited long enough for this.</p></div><div class="comment"><b>Max</b><p>Will there be a night service?</p></div></section></main>
<footer><p>&copy; Harbour Media Ltd</p><a href=/p>Privacy policy</a></footer></body>""",
    ["Ferry returns after two years", "The crossing had been closed since the storm.", "The ferry leaving the harbour on Monday.", "Hundreds of people lined the quay on Monday as the ferry left for the islands for the first time in two years.", "“We had almost given up hope,” said Ruth Lind, who runs the bakery by the pier.", "The company expects to carry a quarter of a million passengers a year."],
)
DOCS = (
    """<body><div class="cookie-banner"><p>We use cookies to understand how you use our site.</p><button>OK</button></div>
<div class="layout"><div class="sidebar"><ul><li><a href=1>Getting started</a></li><li><a href=2>Configuration</a></li><li><a href=3>Reference</a></li></ul></div>
<div class="markdown-body content"><h1>Configuration</h1><p>The server reads its settings from a file named in the environment.</p><pre><code>listen = 8080
workers = 4</code></pre><h2>Options</h2><dl><dt>listen</dt><dd>The port on which the server accepts connections.</dd><dt>workers</dt><dd>How many processes are started.</dd></dl>
<blockquote><p>Changes take effect only after a restart.</p></blockquote></div></div>
<div class="pagination"><a href=0>Previous</a> <a href=4>Next</a></div><footer>Built with plain files. Last deployed in May.</footer></body>""",
    ["Configuration", "The server reads its settings from a file named in the environment.", "listen = 8080 workers = 4", "Options", "listen", "The port on which the server accepts connections.", "workers", "How many processes are started.", "Changes take effect only after a restart."],
)
OLD = (
    """<HTML><BODY><TABLE><TR><TD COLSPAN=2><A HREF="/">Home</A> | <A HREF="/trips">Trips</A> | <A HREF="/guest">Guestbook</A></TD></TR>
<TR><TD WIDTH=120><A HREF="/98">1998</A><BR><A HREF="/99">1999</A><BR><A HREF="/00">2000</A></TD><TD><H2>Walking the ridge in October</H2>
<P>We left the hut at six, while the valley was still under cloud, and reached the first summit an hour later.
<P>The path along the ridge is narrow but never difficult, and the view to the south was the finest of the whole trip.
<P>By noon the wind had risen and we came down through the forest.</TD></TR></TABLE>
<CENTER><FONT SIZE=1>Copyright 2000 by the walking club. Mail the webmaster.</FONT></CENTER></BODY></HTML>""",
    ["Walking the ridge in October", "We left the hut at six, while the valley was still under cloud, and reached the first summit an hour later.", "The path along the ridge is narrow but never difficult, and the view to the south was the finest of the whole trip.", "By noon the wind had risen and we came down through the forest."],
)
BLOG = (
    """<body><div class="wrap"><div class="masthead"><h2><a href="/">Notes on bread</a></h2><p>A weblog about baking</p></div>
<div class="post"><h1>Why rye needs acid</h1><div class="post-content"><p>Rye flour contains enzymes that break down starch while the loaf is still in the oven.</p><p>An acid dough slows them down; <a href="/x">that is why</a> bakers in the north keep a sour culture.</p><ul><li>Feed the culture the night before.</li><li>Use half of it for the dough.</li></ul></div></div>
<div class="share-buttons"><a href=#>Share on Facebook</a><a href=#>Tweet</a></div>
<div class="widget"><h4>Recent posts</h4><ul><li><a href=/1>Salt and time</a></li><li><a href=/2>A stone oven</a></li></ul></div>
<div id="respond"><h3>Leave a reply</h3><form><label>Name</label><input><textarea></textarea><button>Post comment</button></form></div></div>
<div id="footer">Notes on bread, since 2009 &middot; Theme by a friend</div></body>""",
    ["Why rye needs acid", "Rye flour contains enzymes that break down starch while the loaf is still in the oven.", "An acid dough slows them down; that is why bakers in the north keep a sour culture.", "Feed the culture the night before.", "Use half of it for the dough."],
)
PLAIN = ("<h1>A short note</h1><p>There is nothing else on this page.</p><p>It has two paragraphs.</p>", ["A short note", "There is nothing else on this page.", "It has two paragraphs."])


@pytest.mark.parametrize("page", [RECIPE, NEWS, DOCS, OLD, BLOG, PLAIN], ids="recipe news docs old blog plain".split())
def test_pages_by_hand(page):
    source, want = page
    got = main_texts([source], pretrained())[0].split("\n\n")
    assert got == want


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<div>x" * 8000, "<em" * 50_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<tr><td>x" * 20_000, "<script>" * 30_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - began < 1.5


def test_paths_are_shared():
    found = blocks("<div>x" * 8000)
    assert len(found) == 8000 and found[5000].inside.parent is found[4999].inside


def test_long_pages_are_read_in_stretches_alike():
    page = blocks("<nav><a>m</a></nav><article>" + "".join(f"<p>Sentence number {i} of a text.</p>" for i in range(150)) + "</article><footer>f</footer>")
    import glossaria.llm.html_lstm as lstm

    model, whole = pretrained(), None
    for stretch in (STRETCH, 40):
        lstm.STRETCH, before = stretch, lstm.STRETCH
        try:
            got = model.main_blocks([page])[0].tolist()
        finally:
            lstm.STRETCH = before
        assert whole in (None, got)
        whole = got
