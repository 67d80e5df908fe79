"""Pages of another make than the generator's, written by hand, each with its main text."""

P = "The river rose in the night, and by morning the lower road was under water."
Q = "Nobody had seen anything like it since the old bridge was taken down."
R = "The council met at noon to decide what should be done about the road."
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li><li><a href='/c'>Contact</a></li></ul>"
FOOT = "<footer>Copyright 2020 Example Media. All rights reserved.</footer>"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>News</title></head><body>{body}</body></html>"


def text(*blocks: str) -> str:
    return "\n\n".join(blocks)


PAGES = [
    (page(f"<nav>{MENU}</nav><div id=post-body><p>{P}</p><ul><li>One boat</li><li>Two ropes</li></ul><blockquote>{Q}</blockquote></div>{FOOT}"), text(P, "One boat", "Two ropes", Q)),
    (page(f"<nav>{MENU}</nav><main><h1>Results</h1><p>{P}</p><p>{Q}</p></main>{FOOT}"), text("Results", P, Q)),
    (page(f"{P}"), P),
    (page(f"{P}<p>{Q}</p>"), text(P, Q)),
    (f"{P} {Q}", f"{P} {Q}"),
    (page(f"<table><tr><td>{MENU}</td><td><h1>Flood</h1><p>{P}</p><p>{Q}</p></td></tr><tr><td>Sponsored: buy shoes now!</td></tr></table>"), text("Flood", P, Q)),
    (page(f"<div class=nav>{MENU}</div><div class=x17><h2>Flood</h2><p>{P}</p><p>{Q}</p></div><div class=footer>Copyright 2020</div>"), text("Flood", P, Q)),
    (page(f"<header><h1>Daily Example</h1>{MENU}</header><section class=story><h2>Flood</h2><p>{P}</p><h3>After</h3><p>{Q}</p></section><aside><h3>Related</h3><ul><li><a href='/1'>Fire</a></li></ul></aside>{FOOT}"), text("Flood", P, "After", Q)),
    (page(f"<article><h1>Flood</h1><p>{P}</p><div class=ad-slot>Advertisement</div><p>{Q}</p><ol><li>Rain</li><li>Wind</li><li>Snow</li></ol><p>{R}</p></article><section id=comments><h3>Comments</h3><p>I saw it too, it was bad.</p></section>"), text("Flood", P, Q, "Rain", "Wind", "Snow", R)),
    (page(f"<div id=wrapper><div id=menu>{MENU}</div><div id=content><p>{P}</p><table><tr><td>Depth</td><td>2 m</td></tr><tr><td>Width</td><td>9 m</td></tr></table><p>{Q}</p></div><div id=sidebar><p>Popular this week</p>{MENU}</div></div>"), text(P, "Depth", "2 m", "Width", "9 m", Q)),
    (page(f"<nav>{MENU}</nav><article><p>{P}</p></article><div class=newsletter><p>Get our letter every week.</p><form><input name=m><button>Go</button></form></div>{FOOT}"), P),
    (page(f"<div class=cookie-banner>We use cookies to make this site better. <button>Accept</button></div><main><article><h1>Flood</h1><p>{P}</p><pre>depth = 2\nwidth = 9</pre></article></main>"), text("Flood", P, "depth = 2 width = 9")),
    (page(f"<p>{P}</p><p>{Q}</p><p>{R}</p>"), text(P, Q, R)),
    (page(f"<h1>Flood</h1><p>{P}</p><hr><p>{Q}</p>{FOOT}"), text("Flood", P, Q)),
    (page(f"<center><h1>Flood</h1></center><div>{P}<br>{Q}</div>"), text("Flood", f"{P} {Q}")),
    (page(f"<div class=entry-content><h2>Tools</h2><dl><dt>Rope</dt><dd>{P}</dd><dt>Boat</dt><dd>{Q}</dd></dl></div><div class=share>Share <a href='/f'>F</a> <a href='/t'>T</a></div>"), text("Tools", "Rope", P, "Boat", Q)),
    (page(f"<nav>{MENU}</nav><div class=post><div class=post-title><h1>Flood</h1></div><div class=post-text><p>{P}</p><figure><img src=i.png><figcaption>The old bridge</figcaption></figure><p>{Q}</p></div></div><div class=related-posts><a href='/1'>Fire</a><a href='/2'>Storm</a></div>"), text("Flood", P, "The old bridge", Q)),
    (page(f"<div role=navigation>{MENU}</div><div role=main><p>{P}</p><p>{Q}</p></div><div role=contentinfo>Copyright Example</div>"), text(P, Q)),
    (page(f"<article><header><h1>Flood</h1></header><section><h2>Cause</h2><p>{P}</p></section><section><h2>Effect</h2><p>{Q}</p></section></article><footer><p>Contact us</p>{MENU}</footer>"), text("Flood", "Cause", P, "Effect", Q)),
    (page(f"<main><p>{P}</p><blockquote><p>{Q}</p></blockquote><ul><li>{R}</li></ul></main><aside class=widget><h4>Trending</h4><ol><li><a href='/1'>Fire</a></li><li><a href='/2'>Storm</a></li></ol></aside>"), text(P, Q, R)),
]

#: Written after the generator was finished; it was not changed for them. The figure in README is of these.
FRESH = [
    (page(f"<div id=top><a href='/'>Example</a></div><div id=k9><h1>Tide</h1>{P}<p>{Q}</p></div>{FOOT}"), text("Tide", P, Q)),
    (page(f"<main><h2>Steps</h2><ol><li>Boil</li><li>Stir</li><li>Serve</li></ol></main>{FOOT}"), text("Steps", "Boil", "Stir", "Serve")),
    (page(f"<nav>{MENU}</nav><section><p>{P}</p><details><summary>More</summary><p>{Q}</p></details></section>"), text(P, "More", Q)),
    (page(f"<div class=page><div class=col1>{MENU}</div><div class=col2><p>{P}</p><p>{Q}</p><p>{R}</p></div></div>"), text(P, Q, R)),
    (page(f"<article><h1>Tide</h1><p>{P}</p><aside class=pullquote><p>Subscribe for more.</p></aside><p>{Q}</p></article>"), text("Tide", P, Q)),
    (page(f"<table width=100%><tr><td colspan=2><h1>Daily Example</h1></td></tr><tr><td>{MENU}</td><td><p>{P}</p><p>{Q}</p></td></tr></table>"), text(P, Q)),
    (page(f"<header>{MENU}</header><main><h1>Prices</h1><table><tr><th>Good</th><th>Price</th></tr><tr><td>Salt</td><td>4</td></tr></table></main>{FOOT}"), text("Prices", "Good", "Price", "Salt", "4")),
    (f"<p>{P}<p>{Q}<p>{R}", text(P, Q, R)),
    (page(f"<div class=blog><h3>Monday</h3><p>{P}</p><div class=comments-area><p>First!</p><p>So true, I was there.</p></div></div>"), text("Monday", P)),
    (page(f"{P}<br><br>{Q}<div class=footer-links>{MENU}</div>"), f"{P} {Q}"),
    (page(f"<article><p>{P}</p><ul><li><a href='/s'>Source one</a></li><li>{Q}</li></ul></article><div class=tags>Tags: <a href='/r'>river</a></div>"), text(P, "Source one", Q)),
    (page(f"<div class=popup><p>Join our club and save.</p><button>Join</button></div><div itemprop=articleBody><p>{P}</p><h4>Note</h4><p>{Q}</p></div>"), text(P, "Note", Q)),
]
