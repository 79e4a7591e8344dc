"""Declared schemas of the stored tables."""

RSS = (
    "id bigint, title string, link string, desc string, body string, date string, score double, "
    "n_show int, n_click int, n_like int, n_hate int"
)
ARTICLE = (
    "id bigint, title string, link string, body string, date string, score double, site string, n_like int"
)
ARTICLE_EVENT = "id bigint, name string, time timestamp, evt_attr string"
ARTICLE_FEAT = (
    "id bigint, y int, f_site string, f_title_keywords string, f_content_keywords string, f_date string, "
    "f_content_len bigint, f_img_n int, f_like_similarity double, f_hate_similarity double"
)
ARTICLE_TAGS = "id bigint, name string, article_id bigint"
LABELLED_BLOCKS = (
    "id bigint, body string, f_text_n bigint, f_p_n bigint, f_tag_n bigint, f_h_n bigint, f_link_density double, "
    "y int, f_np_n bigint"
)
USER_FEAT = "like_title_kw string, like_content_kw string, hate_title_kw string, hate_content_kw string"
PROCESSED = "id bigint, outcome string"

TABLES = {
    "rss": RSS,
    "article": ARTICLE,
    "article_event": ARTICLE_EVENT,
    "article_feat": ARTICLE_FEAT,
    "article_tags": ARTICLE_TAGS,
    "main_content_feat": LABELLED_BLOCKS,
    "user_feat": USER_FEAT,
    "processed": PROCESSED,
}
