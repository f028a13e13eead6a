"""Labelled pages that the extraction model is trained on.

``data-y="1"`` marks what belongs to the article with everything inside it,
``data-y="0"`` marks a part inside that does not. The marks are taken off before
training. Pages are composed from marked parts in several layouts.
"""

import itertools

_T = "Heavy rain fell over the valley during the night, and the old mill stood under water by dawn."
_U = "Engineers said, on Monday, that the bridge could be opened again before the end of the month."
_S = "It rained."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Money", "About us"))
_READS = "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(("The mill in 1900", "How the bridge was built", "Rain by year")))

#: what surrounds an article
_TOP = [
    f"<nav><ul>{_LINKS}</ul></nav>",
    f'<header><a href="/">The Daily</a><div class="menu"><ul>{_LINKS}</ul></div></header>',
    f'<div id="top-bar" class="navbar"><ul>{_LINKS}</ul></div><div class="breadcrumb"><a href="/">Home</a> &gt; News</div>',
    f'<div class="cookie-notice"><p>We use cookies to improve this site. By going on you accept them.</p><button>OK</button></div><nav>{_LINKS}</nav>',
    '<div class="site-header"><span>The Daily</span></div><form action="/s"><input name="q"><label>Search the archive</label></form>',
]
_MIDDLE = [
    f'<div class="ad">{_S} Buy one umbrella, get another one free today.</div>',
    f'<aside class="sidebar"><h3>Most read</h3><ul>{_LINKS}</ul><p>{_U}</p></aside>',
    '<div class="newsletter"><form><p>Sign up for our letter, every Monday.</p><input><button>Sign up</button></form></div>',
    f'<div class="advert banner"><p>{_T}</p></div><div class="share"><a href="#">Share</a><a href="#">Post</a></div>',
    f'<div class="alert notice">{_U}</div>',
]
_END = [
    "<footer>&copy; 2020 The Daily &middot; All rights reserved. Printed in the valley, by the river.</footer>",
    f'<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>{_T}</p></div><div class="comment"><p>{_S}</p></div></section><footer><p>{_U}</p></footer>',
    f'<div class="related"><h4>More</h4><ul>{_LINKS}</ul></div><div id="footer"><p>{_T}</p></div>',
    f'<div class="reader-comments"><ul><li>{_T}</li><li>{_U}</li></ul></div><div class="copyright">(c) The Daily</div>',
    f'<div class="sidebar widget"><p>{_T}</p><p>{_U}</p></div><div class="footer-links"><a href="/a">Contact</a> <a href="/b">Terms</a></div>',
]
_BODY = [
    f"<h1>Mill under water</h1><p>{_T}</p><p>{_S}</p><p>{_U} <a href='/m'>The mill</a> is closed.</p>",
    f"<h1>Mill</h1><p><b>{_T}<br><p>{_S}</p><p>{_U}</p>",
    f"<h2>Mill under water</h2><div>{_T}</div><ul><li>{_S}</li><li>{_U}</li></ul><blockquote>{_T}</blockquote>",
    f"<p>{_S}</p>",
    f"<h1>Mill</h1><p>{_T}</p><table><tr><td>Rain</td><td>40 mm</td></tr></table><p>{_U}</p><figure><figcaption>{_S}</figcaption></figure><pre>a = 1</pre>",
    f"<div>{_T} {_U}<hr>{_U} {_T}</div>",
    f"<h1>Mill under water</h1>{_T}<br><br>{_U} {_S}",
    f"<h1>Mill</h1><p>{_T}</p><ul>{_READS}</ul><p>{_U}</p>",
    f"<div><div><p>{_T}</p><p>{_S}</p></div><div><h3>Bridge</h3><p>{_U}</p></div></div>",
]
_INSIDE = [
    "",
    f'<div class="ad" data-y="0">{_S} Buy now.</div>',
    f'<aside data-y="0"><p>{_U}</p></aside>',
    f'<ul class="share-buttons" data-y="0">{_LINKS}</ul>',
    f'<div class="comments" data-y="0"><p>{_T}</p></div>',
]
_HOLDERS = [
    "<article data-y='1'>{}</article>",
    "<main><article data-y='1'>{}</article></main>",
    '<div id="content" data-y="1">{}</div>',
    '<div class="wrapper"><div class="post-body" data-y="1">{}</div></div>',
    '<main data-y="1">{}</main>',
    '<div class="page"><div class="entry story" data-y="1">{}</div></div>',
    '<section class="article-text" data-y="1">{}</section>',
    '<table><tr><td><div data-y="1">{}</div></td></tr></table>',
    "<div data-y='1'>{}</div>",
    '<div><div data-y="1">{}</div></div>',
    '<div class="c12" data-y="1">{}</div>',
    '<center><table><tr><td data-y="1">{}</td></tr></table></center>',
]
_ON = 'data-y="1"'
#: how often a bare page counts, as there are fewer of them
BARE_TIMES = 2
#: whole pages without a holder, and without or with little around the article
_BARE = [
    f"<html {_ON}>{_T} {_U}</html>",
    f"<html><body {_ON}>{_T}<br>{_U} {_T}</body></html>",
    f"<html><body {_ON}><p>{_T}</p><p>{_U}</p></body></html>",
    f"<html><body {_ON}><h1>Mill</h1><p>{_T}</p><p>{_S}</p><p>{_U}</p></body></html>",
    f"<html><body><div {_ON}><p>{_T}</p><p>{_U}</p></div></body></html>",
    f"<html><body><div {_ON}>{_T} {_U} {_T}</div></body></html>",
    f"<html><body><div><div {_ON}><h2>Mill</h2>{_T} {_U}</div></div></body></html>",
    f"<html><body><article {_ON}><div>{_T} {_U} {_S}<hr>{_U} {_S} {_T}</div></article></body></html>",
    f"<html><body><article {_ON}><h1>Mill</h1>{_T}<p>{_U}</p></article></body></html>",
    f"<html><body><section {_ON}><p>{_T}</p><ul>{_READS}</ul><p>{_U}</p></section></body></html>",
    f"<html><body><article {_ON}><ul>{_READS}</ul><p>{_T}</p><ol><li>{_U}</li><li>{_S}</li></ol></article></body></html>",
    f"<html><body {_ON}><h1>Mill</h1><p>{_T}</p><p>{_U}</p><ul>{_READS}</ul><p>{_T}</p></body></html>",
    f"<html><body {_ON}><ul data-y='0'>{_LINKS}</ul><h1>Mill</h1><p>{_T}</p><p>{_U}</p><footer data-y='0'>{_S} (c) The Daily</footer></body></html>",
    f"<html><body {_ON}><div data-y='0'><a href='/'>Home</a> | <a href='/w'>World</a></div><p>{_T}</p><p>{_U}</p></body></html>",
    f"<html><body {_ON}><nav data-y='0'>{_LINKS}</nav>{_T}<p>{_U}</p><div class='comments' data-y='0'><p>{_T}</p></div></body></html>",
    f"<html><body><div><ul>{_LINKS}</ul></div><div {_ON}><p>{_T}</p><p>{_U}</p></div><div class='footer'><p>{_U}</p></div></body></html>",
    f"<html><body><table><tr><td><ul>{_LINKS}</ul></td><td {_ON}><p>{_T}</p><p>{_U}</p></td></tr></table></body></html>",
    f"<html><body><div {_ON}><span>{_T}</span> <span>{_U}</span></div></body></html>",
    f"<html><body {_ON}><p>{_T}</p></body></html>",
    f"<html><body><nav><ul>{_LINKS}</ul></nav><div {_ON}><span>{_T}</span></div><footer>{_S} (c) The Daily, by the river.</footer></body></html>",
    f"<html><body><form><p>{_T}</p><input></form><div {_ON}><p>{_U}</p><p>{_T}</p></div><div class='ad'>{_U}</div></body></html>",
]


def built(k: int, holder: str, body: str) -> str:
    """A page of the holder and body, with the other parts taken in turn by ``k``."""
    inner = _INSIDE[(k * 3 + k // len(_BODY)) % len(_INSIDE)]
    article = holder.format(body + inner if k % 2 else inner + body)
    parts = [_TOP[k % len(_TOP)], _MIDDLE[(k // 2) % len(_MIDDLE)], article, _END[(k // 3) % len(_END)]]
    if k % 4 == 1:
        parts[1], parts[2] = parts[2], parts[1]
    head = "<head><title>Mill</title><style>p{margin:0}</style><script>var a='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(parts)}</body></html>"


def pages(held_out: int | None = None, folds: int = 4) -> list[str]:
    """One page for each holder and article body, and the bare ones.

    With ``held_out`` the pages that are not of that fold: a fold leaves out
    whole builds, i.e. every ``folds``-th holder with all its bodies and every
    ``folds``-th bare page, so that no layout of it is seen in training.
    """
    return [page for fold, page in _folded(folds) if fold != held_out]


def held_out_pages(fold: int, folds: int = 4) -> list[str]:
    return [page for own, page in _folded(folds) if own == fold]


def _folded(folds: int):
    for k, (holder, body) in enumerate(itertools.product(_HOLDERS, _BODY)):
        yield k // len(_BODY) % folds, built(k, holder, body)
    for k, page in enumerate(_BARE):
        yield from [(k % folds, page)] * BARE_TIMES
