"""Labelled pages from which operator 1 takes its weights.

Pages are composed of hand-written parts: a layout (which parts, in which order),
a way of marking parts up (by elements, by telling class words, by ids, by class
names that say nothing, by some of these, by tables) and the parts' own contents. What a reader
would call the main text stands between ``<!--[-->`` and ``<!--]-->``, in as many
such pairs as other parts cut it into. ``pages`` makes any number of them; the
same seed gives the same pages.
"""

from __future__ import annotations

import random

OPEN, CLOSE = "<!--[-->", "<!--]-->"

PROSE = (
    "The river has dropped to its lowest mark in nine years, the water board said on Monday.",
    "Engineers measured the depth at three bridges and found the same trend at each of them.",
    "Farmers upstream were asked to water their fields at night.",
    "Flatten the back first, on a coarse stone, until the last half inch shines evenly.",
    "Then hold the bevel at a steady angle and draw the iron towards you, lifting it on the way back.",
    "Ten strokes are often enough.",
    "The meeting opened at seven with twelve members present, and the treasurer reported a balance of forty pounds.",
    "It was agreed to plant the bank behind the hall with primroses.",
    "The path leaves the village by the mill and climbs through beech woods to the ridge, where on clear days the sea can be seen.",
    "Allow four hours for the round, and more after rain, as the clay is slow going.",
    "There is no water on the ridge, so carry enough.",
    "Its maker is unknown, but the dial is engraved in a manner common in the north.",
    "The movement strikes the hours on a bell and runs for eight days.",
    "Why did nobody ask the ferryman, who had seen it all?",
    "Der Fluss steht so tief wie seit neun Jahren nicht mehr, sagte ein Sprecher am Montag.",
    "Wer im Herbst pflanzt, hat im Frühjahr die Hände frei.",
    "Le sentier quitte le village près du moulin et monte dans la forêt jusqu'à la crête.",
    "Il faut compter quatre heures, et davantage après la pluie.",
    "El reloj da las horas con una campana y anda ocho días sin cuerda.",
    "Nadie sabe quién lo hizo, pero la caja es de roble de la región.",
    "She laughed.",
    "Results differ from sample to sample, yet the order of the three methods never changed in our trials (see below).",
)
#: Texts that say little: of a note, a list of names, a caption, a poem.
SHORT = ("One", "Two", "After.", "The end.", "So it is.", "Three men in a boat", "To be continued", "Anna, Tom and the rest of the club", "Rot, grün & blau")
TITLES = ("River levels fall after a dry spring", "How to sharpen a plane iron", "Minutes of the garden club", "A walk to the ridge", "The long case clock of 1740", "Niedrigwasser im Fluss", "Une horloge sans nom")
ITEMS = ("Use plenty of water on the stone.", "Check the edge against the light", "Two spoons of flour", "A map, scale 1:25000", "Carry water", "Festes Schuhwerk")
LINKS = ("Home", "News", "Sport", "Weather", "Contact us", "About", "Tools", "Archive", "Startseite", "Kontakt", "Accueil", "Inicio", "Log in", "Members", "Photos", "Shop", "Travel", "Jobs")
SITES = ("The Town Post", "Museum of Clocks", "Plane and Chisel", "Wanderfreunde", "Club du Moulin")
ADS = (
    "Buy two garden hoses and get one free this weekend only.",
    "Save 30% on winter tyres, order today!",
    "Special offer: book now and pay later.",
    "New shoes from 19.99, free delivery on all orders.",
    "Try our premium plan free for 30 days.",
    "Jetzt bestellen und 20% Rabatt sichern!",
    "Offre spéciale, achetez maintenant.",
    "Compra hoy con descuento.",
    "Insurance for less, get a quote in two minutes.",
    "Advertisement",
    "Sponsored: the ten best knives of the year",
)
NOTICES = ("We use cookies to make this site work.", "This site moves to a new address on Monday.", "By using this site you accept our cookie policy.", "Wir verwenden Cookies.", "Please enable scripts in your browser.", "The shop is closed on the third of June.")
REMARKS = (
    "Great tips, thank you, my old plane cuts again.",
    "I use oil and not water on mine.",
    "I do not agree at all, and I have lived here for thirty years.",
    "Nice one!",
    "Sehr schöner Text, danke.",
    "Does anyone know where to park?",
    "First!",
    "My grandfather had one of these, it never stopped in forty years.",
)
PEOPLE = ("Anna", "walker77", "Tom B.", "Jean-Luc", "plane_fan")
FEET = ("Copyright 2021 {site}. All rights reserved.", "© {site}", "{site}, open daily from ten to five except on Mondays.", "© 2019 {site} · Privacy · Terms", "Powered by a small engine.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Impressum und Datenschutz")
TEASERS = ("Bakery wins prize", "School roof repaired", "A table clock of 1801 with two dials and a moon.", "Five walks for a wet day", "What the mill owner said next", "Neue Brücke eröffnet")

CLASSES = {
    "menu": ("menu", "nav", "navbar", "main-nav", "topnav", "navigation", "nav-menu", "sitemenu", "breadcrumbs"),
    "head": ("header", "site-header", "masthead", "top", "banner", "topbar"),
    "foot": ("footer", "site-footer", "foot", "page-footer", "copyright", "bottom"),
    "side": ("sidebar", "side", "aside", "rail", "right-rail", "widget"),
    "ad": ("ad", "ads", "advert", "ad-box", "adslot", "banner-ad", "sponsored", "promo", "ad-container", "advertisement"),
    "notice": ("notice", "cookie-notice", "cookiebar", "alert", "consent", "site-notice", "gdpr"),
    "remarks": ("comments", "comment-list", "thread", "discussion", "replies", "responses", "user-comments"),
    "more": ("related", "related-posts", "recommended", "more-stories", "teasers", "read-next"),
    "sign": ("newsletter", "subscribe", "signup", "login-box", "search-form"),
    "share": ("share", "social", "share-buttons", "pagination", "pager", "toolbar"),
    "story": ("content", "article", "post", "entry", "story", "main-content", "post-body", "article-text", "text", "body-copy"),
}
ELEMENTS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "story": "article", "remarks": "section", "more": "section", "ad": "div", "notice": "div", "sign": "form", "share": "div"}
STYLES = ("elements", "elements", "classes", "ids", "dumb", "dumb", "mixed", "tables")
LAYOUTS = (
    "head menu notice story remarks side foot",
    "menu story foot",
    "head menu ad story share more foot",
    "notice head story sign remarks foot",
    "menu side story ad foot",
    "head story side more foot",
    "story",
    "ad story remarks",
    "head menu side story share remarks more sign foot",
    "foot menu story",
)


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.style = rng, rng.choice(STYLES)
        self.site, self.names = rng.choice(SITES), 0

    def some(self, pool, low: int, high: int) -> list[str]:
        return [self.rng.choice(pool) for _ in range(self.rng.randint(low, high))]

    def box(self, role: str, inner: str, style: str | None = None) -> str:
        style = style or self.style
        name = self.rng.choice(CLASSES[role])
        if style == "mixed":
            style = "dumb" if role == "story" else self.rng.choice(("elements", "classes", "ids"))
        if style == "elements":
            tag = ELEMENTS[role]
            if role == "story":
                tag = self.rng.choice(("article", "main"))
            own = f' class="{name}"' if tag in ("div", "section") or self.rng.random() < 0.3 else ""
            return f"<{tag}{own}>{inner}</{tag}>"
        if style == "tables":
            return f"<table><tr><td>{inner}</td></tr></table>" if role != "story" else f"<div>{inner}</div>"
        if style == "dumb":
            self.names += 1
            tag = self.rng.choice(("div", "div", "section"))
            own = self.rng.choice((f' class="{self.rng.choice("cxqz")}{self.rng.randint(1, 99)}"', f' class="css-{self.rng.randrange(1 << 24):x}"', f' id="b{self.names}"', ""))
            return f"<{tag}{own}>{inner}</{tag}>"
        return f'<div {"class" if style == "classes" else "id"}="{name}">{inner}</div>'

    def links(self, pool=LINKS) -> str:
        names = self.some(pool, 2, 7)
        way = self.rng.randrange(4)
        if way == 0:
            return "<ul>" + "".join(f'<li><a href="/{k}">{n}</a></li>' for k, n in enumerate(names)) + "</ul>"
        if way == 1:
            return " | ".join(f'<a href="/{k}">{n}</a>' for k, n in enumerate(names))
        if way == 2:
            return " ".join(names)  # a menu that a script makes into links
        return "".join(f'<div><a href="/{k}">{n}</a></div>' for k, n in enumerate(names))

    def part(self, role: str) -> str:
        r = self.rng
        if role == "menu":
            inner = self.links()
            return self.box(role, (self.site + " " + inner) if r.random() < 0.2 else inner)
        if role == "head":
            inner = r.choice((f'<a href="/">{self.site}</a>', f"<div>{self.site}</div>", f"<h1>{self.site}</h1>", f"<h2>{self.site}</h2><p>Local news since 1901</p>"))
            return self.box(role, inner + (self.links() if r.random() < 0.5 else ""))
        if role == "foot":
            line = r.choice(FEET).format(site=self.site)
            inner = r.choice((line, f"<p>{line}</p>", f'<p>{line}</p><a href="/p">Privacy</a> <a href="/t">Terms</a>'))
            return self.box(role, inner)
        if role == "side":
            inner = f"<h3>{r.choice(('Most read', 'Dates', 'About us', 'Meist gelesen'))}</h3>" + r.choice((self.links(TEASERS), f"<p>{r.choice(TEASERS)}</p>", "<p>Next meeting on the first of May in the hall.</p>" + self.links(), "".join(f"<p>{x}</p>" for x in self.some(PROSE, 1, 3))))
            return self.box(role, inner)
        if role == "ad":
            ad = " ".join(self.some(ADS, 1, 3))
            return self.box(role, r.choice((ad, f"<p>{ad}</p>", f'<a href="/buy">{ad}</a>', f"<span>{ad}</span>")))
        if role == "notice":
            note = r.choice(NOTICES)
            return self.box(role, r.choice((note, f"<p>{note}</p>", note + " <button>Accept</button>")))
        if role == "remarks":
            lines = "".join(self.remark() for _ in range(r.randint(1, 5)))
            head = r.choice((f"<h3>{r.randint(1, 30)} comments</h3>", "<h2>Comments</h2>", "<h3>Kommentare</h3>", ""))
            tail = r.choice(("<form><textarea>Leave a reply</textarea><button>Send</button></form>", '<p><a href="/r">Reply</a></p>', ""))
            return self.box(role, head + lines + tail)
        if role == "more":
            head = r.choice(("<h4>You may also like</h4>", "<h3>Related stories</h3>", "<h3>Read next</h3>", ""))
            inner = "".join(r.choice((f'<article class="teaser"><h3><a href="/x">{t}</a></h3></article>', f'<p><a href="/x">{t}</a></p>', f"<article><p>{t}</p></article>", f'<h4><a href="/x">{t}</a></h4><p>{r.choice(PROSE)}</p>')) for t in self.some(TEASERS, 2, 4))
            return self.box(role, head + inner)
        if role == "sign":
            inner = r.choice(("Subscribe to our newsletter and never miss a date.", "Sign up for news by mail", "Search", "Log in to comment"))
            return self.box(role, f'{inner} <form><input name="q"><button>Sign up</button></form>')
        return self.box(role, r.choice(('<a href="#">Share</a> <a href="#">Print</a> <a href="#">Tweet</a>', '<a href="/prev">Previous</a> <a href="/next">Next</a>', '<ul><li><a href="#">1</a></li><li><a href="#">2</a></li></ul>')))

    def remark(self) -> str:
        r = self.rng
        who, said = r.choice(PEOPLE), " ".join(self.some(REMARKS if r.random() < 0.75 else PROSE, 1, 2))
        return r.choice((f"<p>{said}</p>", f"<div><b>{who}</b> 3 days ago</div><p>{said}</p>", f"<article><p>{said}</p></article>", f"<li>{who}: {said}</li>", f"<div><p>{said}</p><a href='/r'>Reply</a></div>"))

    def story(self) -> str:
        r = self.rng
        out = [r.choice((f"<h1>{r.choice(TITLES)}</h1>", f"<h2>{r.choice(TITLES)}</h2>", f"<header><h1>{r.choice(TITLES)}</h1></header>" if self.style == "elements" else "", ""))]
        brief = r.random() < 0.2  # a note of a few words
        plain = r.random() < 0.15  # no paragraphs: text between line breaks, or right in the box
        for _ in range(r.choice((1, 2, 3) if brief else (1, 2, 3, 4, 6, 9))):
            words = r.choice(SHORT) if r.random() < (0.7 if brief else 0.08) else " ".join(self.some(PROSE, 1, 5))
            if r.random() < 0.2:
                words = words.replace("the", '<a href="/x">the</a>', 1)
            if plain:
                out.append(words + r.choice(("<br>", "<br><br>")))
                continue
            own = r.choice(("", "", "", ' class="ad-hoc"', ' class="lead"', ' class="top-note"')) if r.random() < 0.2 else ""
            out.append(f"<p{own}>{words}</p>")
            what = r.random()
            if what < 0.08:
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in self.some(ITEMS, 2, 4)) + "</ul>")
            elif what < 0.13:
                out.append(f"<blockquote><p>{r.choice(PROSE)}</p></blockquote>")
            elif what < 0.18:
                out.append(f"<h3>{r.choice(('After the rain', 'What you need', 'Two doubts', 'Anreise'))}</h3>")
            elif what < 0.22:
                out.append(f"<table><tr><td>{r.choice(ITEMS)}</td><td>{r.choice(ITEMS)}</td></tr></table>")
            elif what < 0.26:
                out.append("<figure><figcaption>The dial before it was cleaned.</figcaption></figure>")
            elif what < 0.40:
                style = self.style if self.style not in ("dumb", "mixed", "tables") else r.choice(("classes", "ids"))
                role = r.choice(("ad", "ad", "sign", "share", "more", "side"))
                out.append(CLOSE + self._styled(role, style) + OPEN)
            elif what < 0.44:
                out.append(f"<div><p>{r.choice(PROSE)} {r.choice(PROSE)}</p></div>")
        inner = OPEN + "".join(out) + CLOSE
        if r.random() < 0.25:
            style = self.style if self.style not in ("dumb", "mixed", "tables") else "classes"
            inner += r.choice((self._styled("remarks", style), "<footer>Posted in <a href='/o'>Oak</a></footer>" if style == "elements" else self._styled("share", style)))
        boxed = self.box("story", inner, None if r.random() < 0.8 else "classes")
        if self.style == "classes" and r.random() < 0.1:
            boxed = f'<div class="content" id="main-content header-{r.choice(("fixed", "top"))}">{inner}</div>'
        return f'<div class="{r.choice(("wrap", "container", "layout has-sidebar", "page"))}">{boxed}</div>' if r.random() < 0.2 else boxed

    def _styled(self, role: str, style: str) -> str:
        before, self.style = self.style, style
        out = self.part(role)
        self.style = before
        return out

    def html(self) -> str:
        if self.rng.random() < 0.04:  # a text file, or a few words typed in
            return OPEN + "\n".join(self.some(SHORT + PROSE, 1, 4)) + CLOSE
        parts = [self.story() if role == "story" else self.part(role) for role in self.rng.choice(LAYOUTS).split()]
        body = "".join(parts)
        if self.rng.random() < 0.06:  # one form around the whole page
            body = f'<form id="aspnetForm">{body}</form>'
        return f"<html><head><title>{self.rng.choice(TITLES)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    """``n`` labelled pages."""
    return [_Page(random.Random(seed * 1_000_003 + k)).html() for k in range(n)]
