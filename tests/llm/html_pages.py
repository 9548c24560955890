"""Pages written by hand, with their main text; none comes from the generator that the trees learn from."""

NEWS = (
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>Harbour reopens - The Daily Example</title>
<link rel=stylesheet href=/s.css><script>window.x = "<p>not text</p>";</script><style>.a > .b { color: red }</style></head>
<body class="page-article">
<div id="cookie-consent" class="consent-bar"><p>We and our partners store information on your device. <button>Accept all</button></p></div>
<header class="masthead"><a href="/" class="logo">The Daily Example</a>
<nav aria-label="Main"><ul><li><a href="/world">World</a><li><a href="/business">Business</a><li><a href="/sport">Sport</a><li><a href="/culture">Culture</a></ul></nav></header>
<main><article class="story">
<h1>Harbour reopens after eight&nbsp;months of repairs</h1>
<p>The old harbour reopened on Monday, eight months after a storm broke the northern wall and sank eleven boats.</p>
<div class="ad-slot" data-slot="mid"><p>Advertisement</p><a href="https://ads.example">Cheap boat insurance</a></div>
<p>&ldquo;We lost a whole season,&rdquo; said the harbour master, <a href="/people/42">Ada Quist</a>, as the first trawler
   came in. &ldquo;But the wall is a metre higher now.&rdquo;</p>
<h2>Costs</h2>
<p>Repairs cost 14 million crowns, of which the state paid two thirds. The rest came from fees &amp; a local levy.</p>
<blockquote>Nobody here will forget that night in February.</blockquote>
<p>The fish market opens again in May.</p>
</article>
<aside class="sidebar"><h3>Most read</h3><ol><li><a href=/a>Ten walks by the sea</a><li><a href=/b>Ferry prices rise again</a><li><a href=/c>Why gulls steal food</a></ol></aside>
<section id="comments" class="comments"><h3>12 comments</h3><div class="comment"><p>Great news, finally we can go sailing again with the children.</p></div>
<div class="comment"><p>The levy was a scandal and everybody in town knows it.</p></div></section></main>
<form class="newsletter"><label>Get our newsletter <input type=email></label><button>Sign up</button></form>
<footer><p>&copy; 2024 The Daily Example. All rights reserved.</p><ul><li><a href=/terms>Terms</a><li><a href=/privacy>Privacy</a></ul></footer>
</body></html>""",
    "Harbour reopens after eight months of repairs The old harbour reopened on Monday, eight months after a storm broke the northern"
    " wall and sank eleven boats. “We lost a whole season,” said the harbour master, Ada Quist, as the first trawler came in. “But the"
    " wall is a metre higher now.” Costs Repairs cost 14 million crowns, of which the state paid two thirds. The rest came from fees &"
    " a local levy. Nobody here will forget that night in February. The fish market opens again in May.",
)

BLOG = (
    """<html><head><title>Sourdough</title></head><body>
<div id="wrapper"><div id="top-menu" class="menu"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/archive">Archive</a></div>
<div id="content"><div class="post"><h1 class="post-title">My third sourdough</h1>
<div class="entry-content">The first two loaves were bricks.<br><br>This time I let the dough rest for twenty hours in a cool room, folded it
four times, and kept the oven at its hottest.<br>
<p>It rose. The crust sang when it came out, and the crumb was open and a little sour.
<p>Next time I will use <em>half</em> rye flour and less salt.
<ul><li>500 g flour</li><li>350 g water</li><li>10 g salt</li></ul>
</div><div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a> <a href="#">Pin it</a></div></div>
<div id="respond" class="comments-area"><h2>Leave a reply</h2><form action="/comment"><textarea name=c>Your comment</textarea><input type=submit value=Send></form>
<ol class="comment-list"><li>Thanks, mine turned out well too, though I had to bake it longer than you say.</li><li>Which flour did you use?</li></ol></div></div>
<div id="sidebar" class="widget-area"><div class="widget"><h3>Archives</h3><ul><li><a href=/1>May</a></li><li><a href=/2>June</a></li></ul></div>
<div class="widget"><h3>About me</h3><p>I bake bread and write about it from a small kitchen in the north of the country.</p></div></div>
<div id="footer">Powered by an engine. Theme by somebody.</div></div></body></html>""",
    "My third sourdough The first two loaves were bricks. This time I let the dough rest for twenty hours in a cool room, folded it four times,"
    " and kept the oven at its hottest. It rose. The crust sang when it came out, and the crumb was open and a little sour. Next time I will use"
    " half rye flour and less salt. 500 g flour 350 g water 10 g salt",
)

MANUAL = (
    """<!DOCTYPE html><html><head><title>split - Manual</title></head><body>
<nav class="toc"><ul><li><a href="#s1">Synopsis</a></li><li><a href="#s2">Description</a></li><li><a href="#s3">See also</a></li></ul></nav>
<div role="main" class="document"><section id="s1"><h1>split</h1><p>Cuts a file into pieces of equal size.</p>
<table><thead><tr><th>Option</th><th>Meaning</th></tr></thead><tbody><tr><td>-b</td><td>bytes in each piece</td></tr><tr><td>-l</td><td>lines in each piece</td></tr></tbody></table></section>
<section id="s2"><h2>Description</h2><p>Without options a piece has a thousand lines, &lt;PREFIX&gt; defaults to <code>x</code>, and names end in <code>aa</code>, <code>ab</code> and so on.</p>
<dl><dt>-a N</dt><dd>use suffixes of N letters</dd><dt>-d</dt><dd>use digits as suffixes instead of letters</dd></dl>
<p>It stops with an error when suffixes run out <svg class="icon"/> before the file ends.</p></section></div>
<footer>Manual of a program, version 9.4. <a href="/bugs">Report a bug</a></footer></body></html>""",
    "split Cuts a file into pieces of equal size. Option Meaning -b bytes in each piece -l lines in each piece Description Without options a piece"
    " has a thousand lines, <PREFIX> defaults to x, and names end in aa, ab and so on. -a N use suffixes of N letters -d use digits as suffixes"
    " instead of letters It stops with an error when suffixes run out before the file ends.",
)

SHOP = (
    """<html><body><div class="notice alert">Free delivery this week only!</div><div class="header"><div class="logo">Lamps &amp; Co</div>
<form action="/search" class="search"><input name=q><button type=submit>Search</button></form></div>
<ul class="breadcrumbs"><li><a href=/>Home</a></li><li><a href=/lamps>Lamps</a></li></ul>
<div class="main-content"><article><h1>How to choose a reading lamp</h1>
<p>A good reading lamp throws its light from behind and beside you, about forty centimetres above the page.</p>
<p>Choose a bulb of 2700 kelvin in the evening. Cooler light keeps you awake, warmer light makes print hard to see.</p>
<div class="promo"><h4>Sponsored</h4><p>Buy two lamps, get the third for half the price.</p></div>
<p>Shades of cloth soften shadows; shades of metal keep the light on the page.</p></article></div>
<div class="related-posts"><h3>You may also like</h3><ul><li><a href=1>Desk lamps</a></li><li><a href=2>Candles for winter</a></li><li><a href=3>Energy labels explained</a></li></ul></div>
<div class="popup modal"><p>Subscribe and save ten percent on your first order with us.</p><input type=email><button>Subscribe</button></div>
<div class="footer"><p>Lamps &amp; Co, 1 Example Street. Prices include tax.</p></div></body></html>""",
    "How to choose a reading lamp A good reading lamp throws its light from behind and beside you, about forty centimetres above the page. Choose a"
    " bulb of 2700 kelvin in the evening. Cooler light keeps you awake, warmer light makes print hard to see. Shades of cloth soften shadows; shades"
    " of metal keep the light on the page.",
)

PLAIN = (
    "<html><head><title>Note</title></head><body><h1>Opening hours</h1><p>The library is open from nine to five on working days."
    "<p>On Saturdays it closes at noon.<hr><p>Bring your card.</body></html>",
    "Opening hours The library is open from nine to five on working days. On Saturdays it closes at noon. Bring your card.",
)

TABLES = (
    """<html><body><table width=100%><tr><td colspan=2 class="header"><a href=/>Town Society</a> <a href=/members>Members</a> <a href=/links>Links</a></td></tr>
<tr><td class="menu" width=120><a href=1>News</a><br><a href=2>History</a><br><a href=3>Photos</a><br><a href=4>Contact</a></td>
<td class="content"><h1>The mill pond</h1><p>The pond was dug in 1741 to drive a corn mill, whose foundations can still be seen when the water is low.</p>
<p>In 1902 the mill burned down. The pond was left to the town on condition that nobody should ever be charged to skate on it.</p></td></tr>
<tr><td colspan=2 class="footer">Last changed in 2003. Write to the webmaster.</td></tr></table></body></html>""",
    "The mill pond The pond was dug in 1741 to drive a corn mill, whose foundations can still be seen when the water is low. In 1902 the mill burned"
    " down. The pond was left to the town on condition that nobody should ever be charged to skate on it.",
)

WIKI = (
    """<!DOCTYPE html><html lang=de><head><title>Kornmuhme - Enzyklop&auml;die</title></head><body><div id="mw-head"><ul class="tabs"><li><a href=/d>Diskussion</a></li><li><a href=/e>Bearbeiten</a></li></ul></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading">Kornmuhme</h1><div id="bodyContent"><p>Die <b>Kornmuhme</b> ist ein <a href=/f>Feldgeist</a> des
Volksglaubens, der Kinder davon abhalten soll, ins Getreide zu laufen.</p><h2>Verbreitung</h2><p>Sagen &uuml;ber sie sind vor allem im Osten des Landes belegt; im S&uuml;den hei&szlig;t sie Roggenmutter.</p></div></div>
<div id="mw-navigation"><div class="portal"><h3>Navigation</h3><ul><li><a href=/h>Hauptseite</a></li><li><a href=/z>Zuf&auml;lliger Artikel</a></li></ul></div></div>
<div id="footer"><ul><li>Der Text ist unter einer freien Lizenz verf&uuml;gbar.</li></ul></div></body></html>""",
    "Kornmuhme Die Kornmuhme ist ein Feldgeist des Volksglaubens, der Kinder davon abhalten soll, ins Getreide zu laufen. Verbreitung Sagen über"
    " sie sind vor allem im Osten des Landes belegt; im Süden heißt sie Roggenmutter.",
)

BROKEN = (
    """<html><body><ul id=nav><li><a href="/>Home</a><li><a href="/x">Shop</a></ul><div class=article><h2>Unfinished <button>Save</h2><p>The page stops in the middle of a tag, and one
quote is missing. <noscript>Please enable scripts</noscript>Nothing else is lost.<p>A last line with <svg viewBox="0 0 1 1"><title>icon</title><path d="M0"/></svg> a picture.<div class="share">Share this: <a href=1>Mail</a></div></div><foo""",
    "Unfinished The page stops in the middle of a tag, and one quote is missing. Nothing else is lost. A last line with a picture.",
)

PAGES = {"wiki": WIKI, "broken": BROKEN, "news": NEWS, "blog": BLOG, "manual": MANUAL, "shop": SHOP, "plain": PLAIN, "tables": TABLES}
