"""Labelled pages: ``data-main`` marks where main text begins, ``data-not`` what in it is none."""

_LONG = (
    "The committee met on Tuesday to discuss the plans for the new bridge, which had been delayed for two years. "
    "Several members asked how the costs had risen, and the engineer gave an answer that satisfied most of them."
)
_MORE = "A second report, which is due in spring, will say how the work can go on while trains keep running."
_MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'
_FIELDS = '<label>Name</label><input name="n"><select><option>One</option></select><button>Send</button>'

LABELLED = [
    f"""<html><head><title>t</title></head><body><header><h1><a href="/">The Site</a></h1></header><nav>{_MENU}</nav>
<article data-main><h1>Bridge delayed again</h1><p>By Ann Example</p><p>{_LONG}</p><p>{_MORE}</p><p>Yes.</p>
<blockquote><p>We will see.</p></blockquote><ul><li>one point that was made</li><li>another</li></ul>
<figure><img src="a.png"><figcaption>The bridge</figcaption></figure></article>
<aside class="sidebar"><h3>Popular</h3>{_MENU}</aside><footer><p>&copy; The Site</p></footer></body></html>""",
    f"""<html><body><div id="cookie-notice" class="cookie banner consent">We use cookies. <button>Accept</button></div>
<div class="header top"><div class="logo">Site</div><div class="menu navigation">{_MENU}</div></div>
<div class="breadcrumb breadcrumbs"><a href="/">Home</a> / <a href="/n">News</a></div>
<div id="content" class="content main post entry" data-main><h1>Title of it</h1><div class="entry-content post-body article-body">
<p>{_LONG}</p><h2>Section</h2><p>{_MORE}</p><div class="ad advert advertisement sponsored" data-not>Buy this now, at half the price.</div>
<p>Short.</p><pre>x = 1</pre><table><tr><th>Year</th><td>Cost</td></tr><tr><td>1990</td><td>12</td></tr></table></div></div>
<div class="sidebar widget">Latest posts {_MENU}</div><div class="share social"><a href="/f">Share</a></div>
<div class="footer bottom">Imprint <a href="/c">Contact</a></div></body></html>""",
    f"""<html><body><main data-main><h2>Evening edition</h2><p>{_LONG}</p><p>{_MORE} <a href="/x">More of it</a>.</p>
<section class="comments" id="comments" data-not><h3>Comments</h3><div class="comment"><p class="comment-author">Bob</p>
<p>I read it all and I think that the bridge will never be built, whatever they say now.</p></div><div class="comment reply">
<p>Indeed, it has been like that for a very long time, and nobody seems to care about it at all.</p></div></section></main>
<section class="related recommended"><h3>Read also</h3>{_MENU}</section><form class="newsletter subscribe signup">{_FIELDS}</form></body></html>""",
    f"""<html><body><div class="page wrapper container"><nav class="nav">{_MENU}</nav><article class="story article" data-main><header class="article-header">
<h1>Story</h1><p class="byline author date">12 May</p></header><p>{_LONG}</p><form data-not class="search">{_FIELDS}</form>
<aside data-not class="related promo"><p>You may also like what others have read on this page today and before.</p></aside>
<div data-not class="notice alert popup modal">Please sign up, so that you do not miss any of our reports in the future.</div>
<p>{_MORE}</p><ol><li>First of all, the road.</li><li>Then the rail.</li></ol><nav data-not class="pagination pager"><a href="/2">2</a></nav>
<footer data-not class="tags meta">Filed under <a href="/t">Transport</a></footer></article>
<div class="ad ads adsense banner">Half the price until Sunday, in all our shops and also by post.</div></div></body></html>""",
    f"""<html><body><div class="ad">A sentence of an advert that is as long as some paragraphs are, but no part of them.</div>
<article data-main><h1>Story again</h1><p><b>Lead in bold.<br><p>{_MORE}</p><p>And.</p><p>{_LONG}</p></article>
<section id="disqus_thread" class="comments discussion responses"><p>It is a long comment of a reader, who had much to say about the story above.</p></section>
<footer>&copy; site &middot; A sentence at the very end of the page, which is none of the story.</footer></body></html>""",
    f"""<html><body><section class="hero intro" data-main><h1>Guide</h1><p>{_LONG}</p></section><section class="text body" data-main><h3>How to</h3>
<p>{_MORE}</p><dl><dt>Bridge</dt><dd>What spans a river, a road or a valley.</dd></dl></section>
<div role="navigation">{_MENU}</div><div role="complementary" class="side"><p>Weather: rain in the north, and some sun on the coast later.</p></div>
<div role="contentinfo" class="copyright legal">All rights reserved. <a href="/p">Privacy</a></div></body></html>""",
]
