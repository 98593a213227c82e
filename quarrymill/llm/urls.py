"""URL filters: host and path rules first, then logistic regression on hashed character n-grams, trained from a small labelled table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, SIZES, STEPS, RATE, DECAY, BLOCK_AT = 1 << 15, (3, 4, 5), 2000, 4.0, 1e-4, 0.5
#: (verdict, host with path). A rule fits its host and all subdomains.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The labelled table's names, invented but for common words: of sites to block and of sites to allow. None is taken from the tables the queries run on.
BLOCKED = """
royal-casino casino-slots slots-casino-vip mega-casino casino-bonus online-casino-club poker-win jackpot-win win-big-prize win-iphone-now lotto-win instant-win-cash sports-bets bets-odds live-bets
bets-bonus free-spins free-prize-claim free-followers free-iphone-gift free-cash-now free-xxx bet-free-tips ads-pixel pop-ads ads-server-x banner-ads ads-click click-track track-pixel pixel-track
track-you-ads user-track-beacon ads-exchange mobile-ads ads-network ads-metrics ads-media retarget-ads email-track geo-track-id ad-trackers web-tracker session-track spam-mill bulk-spam spam-sender spam-links comment-spam link-farm click-farm like-farm seo-farm bot-farm farm-backlinks cheap-meds cheap-viagra cheap-rx
cheap-replica cheap-followers cheap-loans discount-pills diet-pills pills-online pills-rx miracle-pills buy-pills adult-chat adult-cams adult-video adult-dating hot-adult xxx-tube x-rated porn-x sex-cams-x
payday-loans fast-cash-loans crypto-doubler get-rich-fast crack-keygen warez-torrent malware-drop fake-watches replica-bags phishing-login account-verify-now clickbait-shock backlinks-seo hacked-accounts
""".split()
ALLOWED = """
river-notes stone-bakery oak-farm dairy-farm hill-farm farm-museum wind-farm window-repair winter-sports winery-tours twin-peaks library-free free-library open-source free-software-wiki free-press cheap-eats
adult-education adult-literacy address-book roads-and-bridges reads heads-up ballads loads-lab race-track soundtrack railway-track track-and-field alphabet better-health diabetes-care tibet-travel between-us
pillars-of-history caterpillars spillway betony exact-science text-archive next-lesson fox-trail maxwell six-nations linkage-map linen-shop seoul-food chat-history cameras-review camp-fire cash-flow-course
news-daily city-council town-hall weather-station northern-lights theory-lab thistle thorn-hedge heron-watch other-things thread-and-needle method-notes author-index lathe-works breathe-easy theatre weathering
heather another-path ethics-forum mother-tongue tether-ball onions-and-leeks station-house action-research education-board nation-archive edition-press notion-library motion-lab ration-book tradition table-tennis
stable-yard noble-house marble-hall able-hands thunder-bay ninth-floor tenth-street health-north earth-science maths-help hearth-side youth-orchestra truth-table monthly-digest growth-economics anthem-choir
university-press school-district hospital-trust museum-guide court-records parliament-watch poetry-page choir-society garden-club chess-federation hiking-diary cooking-basics physics-notes python-docs kernel-notes
space-station spanish-lessons sparrow-walks sparkling-water newspaper spare-parts spatial-maps apartment-plans apache-history searching-skills
data-atlas map-room bird-survey tide-tables star-charts bread-recipes wood-workshop sewing-circle language-school grammar-notes film-review book-club local-history parish-news football-results swim-team
""".split()
HOSTS = ("{}.com", "www.{}.org", "{}.net", "blog.{}.pages.com", "m.{}.info", "{}.host.net", "www.{}.de", "{}.sites.org", "{}.fr", "{}.top", "shop.{}.eu", "{}.co.uk")
PATHS = ("/", "/en/{}", "/de/{}.html", "", "/fr/{}/", "/index.html", "/about", "/{}/{}", "/es/{}", "/page", "/news/{}.html", "/en/{}/")


def labelled_rows(each: int = 4) -> list[tuple[str, int, str]]:
    """url, label and name. Every name stands in `each` hosts and paths by a rule that is the same for both labels, so that only names tell."""
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for k, name in enumerate(names):
            for j in range(each):
                at = k * each + j
                number = str(7 + at * 37 % 9973)
                rows.append((f"http{'s' * (at % 2)}://" + HOSTS[at % len(HOSTS)].format(name) + PATHS[(at // 2 + at // 24) % len(PATHS)].format(number, number), label, name))
    return [*rows, ("", 0, "")]


LABELLED = tuple((u, label) for u, label, _ in labelled_rows())


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Of rules of one length the alphabetically first wins."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the distinct character n-grams of host and path, which don't share grams, and what each counts: 1 over the root of their
    number, for host and path apart, so that a long path doesn't drown its host."""
    found, value = [], []
    for kind, t in (("h", f"^{host}$"), ("p", f"^{path}$")):
        own = {zlib.crc32(f"{kind}{t[k : k + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for k in range(len(t) - n + 1)}
        found += sorted(own)
        value += [1 / len(own) ** 0.5 if own else 0.0] * len(own)
    return np.array(found, np.int64), np.array(value)


def split(url: str) -> tuple[str, str]:
    """Host and path as host_of and path_of have them."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((k for c in "?#" if (k := tail.find(c)) >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def train(labelled=LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the logistic loss with L2 decay; both labels weigh the same, however many rows they have."""
    rows = [grams(*split(u)) for u, _ in labelled]
    y = np.array([float(v) for _, v in labelled])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(BUCKETS), 0.0
    flat, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    which = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    for _ in range(STEPS):
        g = (1 / (1 + np.exp(-(np.bincount(which, w[flat] * value, len(rows)) + b))) - y) * weight
        w -= RATE * (np.bincount(flat, value * g[which], BUCKETS) + DECAY * w)
        b -= RATE * g.sum()
    return w, b


def p_block(host: str, path: str, w: np.ndarray, bias: float) -> float:
    at, value = grams(host, path)
    return float(1 / (1 + np.exp(-(w[at] @ value + bias))))


def errors(every: int = 5) -> dict[str, float]:
    """Of every fifth name of the table, by crc32, held out from training: the share of blocked rows allowed, and of allowed rows blocked."""
    rows = labelled_rows()
    out = lambda name: zlib.crc32(name.encode()) % every == 0
    w, bias = train([(u, v) for u, v, name in rows if not out(name)])
    judged = [(v, p_block(*split(u), w, bias) >= BLOCK_AT) for u, v, name in rows if name and out(name)]
    share = lambda label, hit: sum(h == hit for v, h in judged if v == label) / max(sum(v == label for v, _ in judged), 1)
    return {"rows": len(judged), "missed": share(1, False), "wrongly_blocked": share(0, True)}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, block_at: float = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block (the model's) of every row.

    Rules decide where one fits, else the model: block where p_block >= block_at. A null url, or one without "://", has an empty host and
    path, which no rule fits; the model judges it like any other. Repeated rows give a row each; an empty table gives none; other columns,
    whatever their names, aren't read; long urls are judged whole, all their grams counting. One pass without a shuffle.
    """
    spark = pages.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    w, bias = train(labelled)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = [p_block(host, path, w, bias) for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "p_block"])

    parts = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(pages[url_col].cast("string")).alias("host"), path_of(pages[url_col].cast("string")).alias("path"))
    scored = parts.mapInArrow(common.lean(task), "page_id long, host string, path string, p_block double")
    got = scored.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    model = F.when(F.col("p_block") >= block_at, "block").otherwise("allow")
    return got.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", model).alias("verdict"), "p_block")


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(common.table(spark, sf_dir, "pages"))
