"""Fixed seed tables of the crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# URL rules, allowed domains and start pages.
URL_RULES = [
    ("arxiv.org", ["/abs/"]),
    ("www.solidot.org", ["/story"]),
    ("www.leiphone.com", ["/news", "/latest"]),
    ("www.nature.com", ["/articles/"]),
    ("vip.stock.finance.sina.com.cn", ["/q/go.php/vReport_Show/"]),
    ("www.infoq.cn", ["/article/"]),
    ("36kr.com", ["/p/"]),
    ("cnbeta.com", ["/articles/"]),
    ("www.e0734.com", ["/html/2"]),
    ("hn.rednet.cn", ["/content/2"]),
    ("cn.investing.com", ["/news/"]),
    ("zhuanlan.zhihu.com", ["/p/"]),
    ("www.jiqizhixin.com", ["/articles/"]),
]

ALLOWED_DOMAINS = [
    "zhihu.com",
    "news.ustc.edu.cn",
    "bbs.ustc.edu.cn",
    "www.jiqizhixin.com",
    "deepmind.com",
    "new.qq.com",
    "leiphone.com",
    "ai.yanxishe.com",
    "wallstreetcn.com",
    "tech.meituan.com",
    "technologyreview.com",
    "arxiv.org",
    "www.nature.com",
    "www.solidot.org",
    "vip.stock.finance.sina.com.cn",
    "www.infoq.cn",
    "36kr.com",
    "cnbeta.com",
    "www.e0734.com",
    "hn.rednet.cn",
    "cn.investing.com",
]

START_URLS = [
    "https://www.zhihu.com/explore/recommendations",
    "http://news.ustc.edu.cn/",
    "https://www.jiqizhixin.com/",
    "https://deepmind.com/blog/",
    "https://new.qq.com/ch/tech/",
    "https://new.qq.com/ch/finance/",
    "https://new.qq.com/ch/world/",
    "https://new.qq.com/d/bj",
    "https://news.qq.com/",
    "https://new.qq.com/d/hn",
    "https://new.qq.com/d/zj",
    "http://bbs.ustc.edu.cn/cgi/bbsdoc?board=Notice",
    "https://www.leiphone.com/",
    "https://ai.yanxishe.com/",
    "https://wallstreetcn.com/news/global",
    "https://wallstreetcn.com/news/economy",
    "https://wallstreetcn.com/news/charts",
    "https://wallstreetcn.com/news/china",
    "https://wallstreetcn.com/news/us",
    "https://wallstreetcn.com/news/shares",
    "https://tech.meituan.com/",
    "https://daily.zhihu.com/",
    "https://www.technologyreview.com/",
    "https://arxiv.org/list/cs.AI/recent",
    "https://arxiv.org/list/cs.CV/recent",
    "https://arxiv.org/list/cs.LG/recent",
    "https://www.solidot.org/",
    "https://www.nature.com/news",
    "http://vip.stock.finance.sina.com.cn/q/go.php/vReport_List/kind/industry/index.phtml",
    "https://www.infoq.cn/",
    "https://36kr.com/",
    "https://www.cnbeta.com/",
    "http://www.e0734.com/",
    "https://hn.rednet.cn/",
    "https://cn.investing.com/news/",
    "https://cn.investing.com/news/latest-news",
    "https://www.jiqizhixin.com/columns/paperweekly",
]


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(URL_RULES, "domain string, prefixes array<string>")


def allowed_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in ALLOWED_DOMAINS], "domain string")


def start_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in START_URLS], "url string")
