"""Pages that the block labeller learns from: articles of many layouts among everything that sites put around them.

Every block of main text holds MARK. Words, phrases, marks and layouts are drawn at random; none is taken from pages
that the labeller is applied to.
"""

from __future__ import annotations

import random

#: A character that training pages write into main text; it is taken out before vectors are made.
MARK = "\u2060"

#: Common words of four languages.
ENGLISH = """the of and to in a is that it was for on are as with his they be at one have this from by hot but some what there we
can out other were all your when up use word how said an each she which do their time if will way about many then them
would write like so these her long make thing see him two has look more day could go come did my sound no most number who
over know water than call first people may down side been now find any new work part take get place made live where after
back little only round man year came show every good me give our under name very through just form much great think say
help low line before turn cause same mean differ move right boy old too does tell sentence set three want air well also
play small end put home read hand port large spell add even land here must big high such follow act why ask men change""".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()
FRENCH = "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ou avec son aux d'un cette d'une ont ses mais comme on tout nous sa fait été aussi leur bien peut ces y deux".split()
SPANISH = "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split()

#: What stands in the parts of a page that aren't its article.
MENU = """Home|About|About us|Contact|Contact us|News|Blog|Products|Services|Shop|Support|Help|FAQ|Team|Careers|Events|Gallery|Archive|Login|Log in|Sign in|Register|My account|Cart|Search|Menu|Start|Über uns|Kontakt|Impressum|Accueil|Nos services|Inicio|Contacto|Sports|Politics|Business|Culture|Travel|Opinion|Weather|Videos|Recipes|Forum|Docs|Pricing|Download""".split("|")
FOOTER = """All rights reserved.|Privacy policy|Terms of use|Terms and conditions|Imprint|Legal notice|Sitemap|Powered by our own software|Back to top|Accessibility|Cookie settings|Follow us|Made with care in Europe|Datenschutz|Mentions légales|Aviso legal|Contact: info at this site|Advertise with us""".split("|")
NOTICE = """We use cookies to improve your experience.|This site uses cookies. By continuing you agree to our policy.|Accept all|Reject|Manage preferences|Your privacy is important to us and our partners.|Please enable JavaScript.|You are using an outdated browser.|Wir verwenden Cookies.|Nous utilisons des cookies.|Utilizamos cookies.|Subscribe to continue reading.|You have read all your free articles this month.""".split("|")
ADVERT = """Advertisement|Sponsored|Sponsored content|Ad|Buy now and save|Limited offer: half price today|Shop the sale|Try it free for a month|Anzeige|Publicité|Publicidad|Free delivery on all orders|Compare prices now""".split("|")
FORM = """Sign up to our newsletter|Subscribe to our newsletter|Enter your email address|Get the latest stories in your inbox|Subscribe|Submit|Send|Your name|Your email|Search this site|Password|Remember me|Forgot password?|Newsletter abonnieren|Join our mailing list""".split("|")
SIDEBAR = """Related articles|Related posts|You might also like|Most read|Popular posts|Trending now|Recent comments|Recent posts|Categories|Tags|Archives|Read next|More from this author|Editor's picks|Recommended for you|Read more|See all""".split("|")
SHARE = """Share|Share this|Tweet|Share on Facebook|Pin it|Email this|Print|Copy link|Like|Save|Follow|Share this article""".split("|")
COMMENTS = """Comments|Leave a comment|Leave a reply|Reply|Report|Join the discussion|Add your comment|Log in to reply|Great post, thanks for sharing!|I totally disagree with this.|Thanks, this helped me a lot.|First!|Can anybody explain this to me?|Kommentare|Commentaires""".split("|")
PHRASES = {"menu": MENU, "header": MENU, "footer": FOOTER, "notice": NOTICE, "advert": ADVERT, "form": FORM, "sidebar": SIDEBAR, "share": SHARE, "comments": COMMENTS}

#: Class and id words of what is and isn't main text, and of neither.
MAIN_MARKS = "content main article post entry story article-body post-content entry-content page-content text body-text article__body recipe documentation markdown-body prose chapter".split()
PLAIN_MARKS = "container wrapper row col page inner grid block box layout section wrap site root app cell left right".split()
MARKS = {
    "menu": "nav menu navbar main-menu top-nav breadcrumb breadcrumbs pagination tabs navigation toc".split(),
    "header": "header site-header masthead topbar branding logo banner".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "sidebar": "sidebar aside side widget related recommended popular trending tags rail".split(),
    "notice": "cookie cookies consent notice gdpr cookie-banner alert popup modal privacy-notice paywall".split(),
    "advert": "ad ads advert advertisement sponsored promo ad-slot adsense banner-ad".split(),
    "form": "form search login signup newsletter subscribe contact-form search-form".split(),
    "comments": "comments comment comment-list replies discussion respond comment-body thread".split(),
    "share": "share social sharing follow buttons social-links".split(),
}
_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvwz") * (rng.random() < 0.85) + rng.choice("aeiouy") + rng.choice(["", "", "n", "r", "s", "l"]) for _ in range(rng.randint(1, 4)))


class _Writer:
    """One page's language, names and habits."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.common = rng.choice([ENGLISH, ENGLISH, ENGLISH, GERMAN, FRENCH, SPANISH, []])
        self.names = [_word(rng) for _ in range(rng.randint(20, 120))]
        self.noise = rng.random() < 0.12  # texts full of stray marks, capitals or repeats
        self.closes, self.inline = rng.random() > 0.2, rng.choice([0.0, 0.1, 0.3])
        self.opaque = rng.random() < 0.15  # class names that say nothing
        self.upper = rng.random() < 0.04

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        out = [rng.choice(self.common) if self.common and rng.random() < 0.5 else rng.choice(self.names) for _ in range(rng.randint(low, high))]
        if self.noise:
            style = rng.random()
            out = [w.upper() for w in out] if style < 0.25 else [w + rng.choice(["", *"#*%$+=|~"]) * rng.randint(1, 3) for w in out] if style < 0.75 else out[:1] * len(out)
        for i in range(len(out)):
            if rng.random() < self.inline / 3:
                tag = rng.choice(["b", "i", "em", "strong", "span", "code", "u"])
                out[i] = f"<{tag}>{out[i]}</{tag}>" if rng.random() < 0.9 else f"<{tag}>{out[i]}"
            elif rng.random() < self.inline / 4:
                out[i] = f'<a href="/{rng.choice(self.names)}">{out[i]}</a>'
        return " ".join(out)

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            text = self.words(2, 22)
            out.append(text[:1].upper() + text[1:] + self.rng.choice([".", ".", ".", "?", "!", "", ","]))
        return self.rng.choice([" ", " ", " ", "<br>"]).join(out)

    def main(self, low: int, high: int) -> str:
        return MARK + self.sentences(low, high)

    def tag(self, name: str, inner: str, mark: str = "") -> str:
        left_open = not self.closes and name in ("p", "li", "td", "tr", "dd", "dt") and self.rng.random() < 0.7
        return f"<{name}{mark}>{inner}" + ("" if left_open else f"</{name}>")

    def marks(self, words: list[str], chance: float = 0.8) -> str:
        rng = self.rng
        if rng.random() > chance:
            return ""
        if self.opaque:
            return f' class="css-{rng.randrange(16**5):05x}"'
        value = " ".join(rng.sample(words, min(len(words), rng.choice([1, 1, 1, 2]))))
        if rng.random() < 0.2:
            value += " " + rng.choice(PLAIN_MARKS)
        return f' {rng.choice(["class", "class", "id"])}="{value}"'


def _boiler(w: _Writer, kind: str) -> str:
    rng, phrases = w.rng, PHRASES[kind]
    said = lambda: rng.choice(phrases) if rng.random() < 0.6 else w.words(1, 4)
    tag = _TAGS.get(kind)
    outer = tag if tag and rng.random() < 0.6 else rng.choice(["div", "div", "div", "section", "ul" if kind in ("menu", "share") else "div", "center" if kind in ("footer", "menu", "advert") else "div"])
    mark = w.marks(MARKS[kind], 0.5 if outer == tag else 0.2 if outer == "center" else 0.9)
    links = lambda n: [f'<a href="/{rng.choice(w.names)}">{said()}</a>' for _ in range(n)]
    inner = []
    if kind == "form":
        inner.append(rng.choice([f"<label>{said()}</label><input name=q><button>{said()}</button>", f"<h3>{said()}</h3><p>{said()}</p><input><button>{said()}</button>", f"<p>{said()}</p><input type=email>", said()]))
    elif kind in ("menu", "share") or kind in ("sidebar", "footer", "header") and rng.random() < 0.55:
        some = links(rng.randint(1, 9))
        inner.append(rng.choice(["".join(w.tag("li", x) for x in some) if outer == "ul" else f"<ul>{''.join(w.tag('li', x) for x in some)}</ul>", " | ".join(some), "".join(f"<div>{x}</div>" for x in some), " » ".join(some)]))
    if kind == "comments":
        inner.append(rng.choice(["", f"<h3>{rng.choice(phrases)}</h3>", f"<h2>{rng.randint(1, 90)} {rng.choice(phrases)}</h2>"]))
        inner += [f"<{t}{w.marks(MARKS[kind], 0.5)}><b>{w.words(1, 2)}</b> <p>{w.sentences(1, 3) if rng.random() < 0.7 else said()}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 6)]
    if kind == "sidebar" and rng.random() < 0.5:
        inner += [f"<h4>{said()}</h4>", *(f'<div><a href="/x">{w.words(3, 9)}</a><p>{w.sentences(1, 2)}</p></div>' for _ in range(rng.randint(0, 3)))]
    if kind == "footer" and rng.random() < 0.7:
        inner.append(rng.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<small>{}</small>"]).format(f"{rng.choice(['&copy;', '©', '&#169;', 'Copyright'])} {rng.choice([str(rng.randint(1995, 2030)), ''])} {w.words(1, 4)}{rng.choice([' &middot; ', '. ', ' - '])}{rng.choice([rng.choice(FOOTER), w.sentences(1, 2)])}"))
    if not inner or rng.random() < 0.35:
        text = said() if rng.random() < 0.5 else w.sentences(1, 3)
        inner.append(rng.choice([text, f"<p>{text}</p>", f"<h3>{text}</h3>", f"<div>{text}</div>"]))
    return f"<{outer}{mark}>{''.join(inner)}</{outer}>"


def _figures(w: _Writer) -> str:
    rng = w.rng
    rows = [[MARK + w.words(1, 6) for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(1, 5))]
    table = "".join(w.tag("tr", "".join(w.tag("th" if k == 0 and rng.random() < 0.6 else "td", x) for x in row)) for k, row in enumerate(rows))
    return f"<table>{f'<caption>{w.main(1, 1)}</caption>' if rng.random() < 0.3 else ''}{table}</table>"


def _article(w: _Writer) -> str:
    rng, parts = w.rng, []
    if rng.random() < 0.85:
        title = f"<h1>{MARK}{w.words(1, 12)}</h1>"
        parts.append(f"<header>{title}</header>" if rng.random() < 0.12 else title)
    if rng.random() < 0.15:
        parts.append(f"<p{w.marks(['byline', 'meta', 'author', 'date'])}>{MARK}{w.words(2, 6)}</p>")
    for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 10, 16, 24])):
        shape, size = rng.random(), rng.choice([(1, 1), (1, 2), (1, 5), (3, 9)])
        if shape < 0.56:
            parts.append(w.tag("p", w.main(*size)))
        elif shape < 0.62:
            parts.append(rng.choice([f"<div>{w.main(*size)}</div>", w.main(*size) + "<br><br>" + w.sentences(1, 3), f"<section><h3>{w.main(1, 1)}</h3>{w.tag('p', w.main(*size))}</section>"]))
        elif shape < 0.72:
            parts.append(f"<h{(n := rng.randint(2, 4))}>{MARK}{w.words(1, 8)}</h{n}>")
        elif shape < 0.82:
            kind = rng.choice(["ul", "ol"])
            parts.append(f"<{kind}>{''.join(w.tag('li', rng.choice([w.main(1, 1), MARK + w.words(1, 7)])) for _ in range(rng.randint(1, 7)))}</{kind}>")
        elif shape < 0.87:
            parts.append(f"<blockquote>{rng.choice([w.main(1, 3), w.tag('p', w.main(1, 3))])}</blockquote>")
        elif shape < 0.92:
            parts.append(_figures(w))
        elif shape < 0.95:
            parts.append(f"<pre><code>{MARK}{w.words(2, 30)} = {{}};</code></pre>")
        elif shape < 0.97:
            parts.append(f"<figure><img src=x><figcaption>{w.main(1, 1)}</figcaption></figure>")
        elif shape < 0.985:
            parts.append("<dl>" + "".join(w.tag("dt", MARK + w.words(1, 3)) + w.tag("dd", w.main(1, 2)) for _ in range(rng.randint(1, 4))) + "</dl>")
        else:
            parts.append(f'<p><a href="/y">{MARK}{w.words(2, 8)}</a></p>')
        if rng.random() < 0.1:
            parts.append(_boiler(w, rng.choice(["advert", "advert", "share", "form", "notice", "sidebar"])))
    if rng.random() < 0.2:
        parts.append(_boiler(w, rng.choice(["comments", "share", "sidebar", "form"])))
    return "".join(parts)


def training_page(rng: random.Random) -> str:
    """A page whose main text has MARK in every block."""
    w, before, after = _Writer(rng), [], []
    for kind, chance in (("notice", 0.25), ("header", 0.45), ("menu", 0.75), ("advert", 0.35), ("form", 0.1), ("share", 0.05)):
        if rng.random() < chance:
            before.append(_boiler(w, kind) if rng.random() < 0.9 else f"<!-- {kind} -->{_boiler(w, kind)}")
    for kind, chance in (("share", 0.15), ("comments", 0.25), ("sidebar", 0.2), ("form", 0.2), ("advert", 0.15), ("menu", 0.1), ("footer", 0.8), ("notice", 0.1)):
        if rng.random() < chance:
            after.append(_boiler(w, kind))
    outer = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
    main = f"<{outer}{w.marks(MAIN_MARKS, 0.4 if outer in ('article', 'main') else 0.75)}>{_article(w)}</{outer}>"
    side = _boiler(w, "sidebar") if rng.random() < 0.35 else ""
    if outer == "td":
        cells = rng.sample([main, f"<td>{side or _boiler(w, 'menu')}</td>"], 2)
        middle = f"<table><tr>{''.join(cells)}</tr></table>"
    else:
        middle = rng.choice([side + main, main + side])
    if rng.random() < 0.3:
        middle = f"<div{w.marks(PLAIN_MARKS)}>{middle}</div>"
    body = "".join([*before, middle, *after])
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        body = f"<div{w.marks(PLAIN_MARKS)}>{body}</div>"
    page = f"<!DOCTYPE html><html><head><title>{w.words(1, 5)}</title></head><body>{body}</body></html>"
    return page.upper().replace(MARK.upper(), MARK) if w.upper else page
