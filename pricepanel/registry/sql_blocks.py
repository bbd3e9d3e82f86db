"""Named DuckDB statements that the oracle queries build on, in order of dependence."""

from __future__ import annotations

from pricepanel.registry.fixture import ANCHOR, CHECK_DAYS, OFFER_PAGE, PRODUCT_PAGE, RAW_QUOTES, START

PAIR = "PARTITION BY seller, isbn ORDER BY dateacc"
DAY = "PARTITION BY isbn, dateacc"
SPACE = r"[ \t\n\r\f]"
PUNCT = r"[!-/:-@\[-`{-~]"


def wsd(x: str, w: str, keys: str) -> str:
    """Weighted sd as an aggregate; the mean comes from a column m_<x>."""
    return f"CASE WHEN sum({w}) > 1 THEN sqrt(sum({w} * pow({x} - m_{x}, 2)) / (sum({w}) - 1)) END"


def wmean(x: str, w: str) -> str:
    return f"sum({w} * {x}) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN {w} END), 0)"


def centre(x: str, w: str, keys: str) -> str:
    return f"sum({w} * {x}) OVER (PARTITION BY {keys}) / nullif(sum({w}) OVER (PARTITION BY {keys}), 0) AS m_{x}"


BLOCKS: dict[str, str] = {}

BLOCKS["raw_quotes"] = RAW_QUOTES.replace("`", '"').replace("{lineitem}", "lineitem").replace("{part}", "part")
BLOCKS["all_quotes"] = """
SELECT dateacc, isbn, seller, try_cast(replace(rating, '%', '') AS DOUBLE) AS rating, fba,
       try_cast(replace(coalesce(numrating, '0'), ',', '') AS DOUBLE) AS numrating,
       price + coalesce(shipping, 0.0) AS price2, l_orderkey, l_linenumber, l_partkey
FROM raw_quotes
"""
BLOCKS["typed_quotes"] = "SELECT * FROM all_quotes WHERE seller <> ''"
BLOCKS["quotes"] = """
SELECT * FROM typed_quotes
QUALIFY row_number() OVER (PARTITION BY seller, isbn, dateacc ORDER BY price2, l_orderkey, l_linenumber, l_partkey) = 1
"""
BLOCKS["medians"] = "SELECT isbn, dateacc, median(price2) AS price_median FROM all_quotes GROUP BY ALL"
BLOCKS["below_median"] = """
SELECT * FROM all_quotes JOIN medians USING (isbn, dateacc) WHERE price2 - 3.99 < 2 * price_median
"""
BLOCKS["list_prices"] = """
SELECT p_brand AS isbn, CASE WHEN p_brand <> 'Brand#7' THEN avg(p_retailprice) END AS list_price, min(p_type) AS format
FROM part GROUP BY p_brand
"""
BLOCKS["below_list"] = """
SELECT b.*, list_price FROM below_median b LEFT JOIN list_prices USING (isbn)
WHERE price2 - 3.99 < 1.5 * list_price OR list_price IS NULL
"""
BLOCKS["near_quotes"] = """
SELECT * FROM below_list WHERE seller <> ''
QUALIFY row_number() OVER (PARTITION BY seller, isbn, dateacc ORDER BY price2, l_orderkey, l_linenumber, l_partkey) = 1
"""
BLOCKS["ranked"] = f"""
SELECT *, row_number() OVER ({DAY} ORDER BY price2, seller) AS rank FROM near_quotes
"""
BLOCKS["price_floor"] = "SELECT median(price2) AS price_floor FROM ranked WHERE rank = 1"
BLOCKS["floor_products"] = """
SELECT isbn, avg(CASE WHEN price2 < (SELECT price_floor FROM price_floor) THEN 1 ELSE 0 END) AS share_under_floor,
       count(*) AS days
FROM ranked WHERE rank = 1 GROUP BY isbn HAVING share_under_floor < 0.5
"""
BLOCKS["anchored"] = f"SELECT DISTINCT isbn FROM ranked WHERE seller = '{ANCHOR}'"
BLOCKS["kept"] = f"""
SELECT dateacc, isbn, seller, rank, price2,
       CASE WHEN seller = '{ANCHOR}' THEN 100.0 ELSE rating END AS rating,
       CASE WHEN seller <> '{ANCHOR}' THEN numrating END AS numrating,
       CASE WHEN seller = '{ANCHOR}' THEN 1 ELSE fba END AS fba
FROM ranked WHERE isbn IN (SELECT isbn FROM floor_products) AND isbn IN (SELECT isbn FROM anchored)
"""
BLOCKS["panel"] = f"""
SELECT * FROM (
  SELECT *, lag(rank) OVER w AS rank_prev, date_diff('day', lag(dateacc) OVER w, dateacc) AS days_bet
  FROM kept WINDOW w AS ({PAIR})
) WHERE dateacc >= DATE '{START}'
"""
BLOCKS["lagged"] = f"""
SELECT *, lag(price2) OVER w AS price2_prev, price2 - lag(price2) OVER w AS price2_change,
       date_diff('day', dateacc, lead(dateacc) OVER w) AS days_next,
       CASE WHEN rank <= 15 THEN 1 ELSE 0 END AS first_page
FROM panel WINDOW w AS ({PAIR})
"""
BLOCKS["placed"] = f"""
SELECT *, lag(price2) OVER r AS price_next_lowest, lead(price2) OVER r AS price_next_highest,
       min(price2) FILTER (WHERE rank = 1) OVER d AS price_lowest,
       min(price2) FILTER (WHERE seller = '{ANCHOR}') OVER d AS price_anchor
FROM lagged WINDOW r AS ({DAY} ORDER BY rank), d AS ({DAY})
"""
BLOCKS["distances"] = """
SELECT *, (price2 - price_next_lowest) / nullif(price2, 0) AS pct_diff_next_lowest,
       (price2 - price_next_highest) / nullif(price2, 0) AS pct_diff_next_highest,
       (price2 - price_lowest) / nullif(price2, 0) AS pct_diff_lowest,
       (price2 - price_anchor) / nullif(price2, 0) AS pct_diff_anchor
FROM placed
"""
BLOCKS["marks"] = f"""
SELECT *, lag(dateacc) OVER w AS mark_day, lag(rank) OVER w AS mark_rank
FROM distances WHERE price2_change <> 0 OR price2_change IS NULL WINDOW w AS ({PAIR})
"""
BLOCKS["changes"] = f"""
SELECT *, CASE WHEN price2_change > 0 THEN 1 ELSE 0 END AS price_inc,
       CASE WHEN price2_change > 0 THEN 0 ELSE 1 END AS price_dec,
       price2_change / nullif(price2_prev, 0) AS pct_change,
       date_diff('day', mark_day, dateacc) AS days_bet_change,
       mark_rank AS rank_last_change, rank_prev - mark_rank AS ranks_bumped,
       CASE WHEN row_number() OVER ({PAIR}) = 1 THEN 1 ELSE 0 END AS first_change
FROM marks WHERE price2_change IS NOT NULL
"""
BLOCKS["pair_changes"] = """
SELECT seller, isbn, sum(price_inc) AS num_price_inc, sum(price_dec) AS num_price_dec, count(*) AS num_price_change
FROM changes GROUP BY ALL
"""
BLOCKS["page_days"] = """
SELECT seller, isbn, coalesce(sum(days_next), 0) AS days_observed, coalesce(sum(days_next * first_page), 0) AS days_first_page
FROM lagged GROUP BY ALL
"""
BLOCKS["pair_rates"] = """
SELECT *, days_first_page / nullif(days_observed, 0) AS pct_first_page,
       num_price_change / nullif(days_observed, 0) AS changes_per_day,
       num_price_inc / nullif(days_observed, 0) AS inc_per_day,
       num_price_dec / nullif(days_observed, 0) AS dec_per_day,
       CASE WHEN num_price_change = 0 THEN 1 ELSE 0 END AS no_change
FROM (SELECT coalesce(c.seller, p.seller) AS seller, coalesce(c.isbn, p.isbn) AS isbn,
             coalesce(num_price_inc, 0) AS num_price_inc, coalesce(num_price_dec, 0) AS num_price_dec,
             coalesce(num_price_change, 0) AS num_price_change,
             coalesce(days_observed, 0) AS days_observed, coalesce(days_first_page, 0) AS days_first_page
      FROM pair_changes c FULL JOIN page_days p ON c.seller = p.seller AND c.isbn = p.isbn)
"""
BLOCKS["totals"] = """
SELECT seller, sum(num_price_inc) AS num_price_inc, sum(num_price_dec) AS num_price_dec,
       sum(num_price_change) AS num_price_change, sum(no_change) AS listings_no_change,
       coalesce(avg(days_observed), 0) AS avg_days_observed, coalesce(avg(days_first_page), 0) AS avg_days_first_page,
       coalesce(avg(pct_first_page), 0) AS avg_pct_first_page, coalesce(avg(changes_per_day), 0) AS avg_changes_per_day,
       coalesce(avg(inc_per_day), 0) AS avg_inc_per_day, coalesce(avg(dec_per_day), 0) AS avg_dec_per_day,
       coalesce(sum(num_price_inc) / nullif(sum(num_price_change), 0), 0) AS prop_changes_inc
FROM pair_rates GROUP BY seller
"""
BLOCKS["moments"] = """
SELECT seller, avg(days_bet_change) AS avg_days_bet_change, stddev_samp(days_bet_change) AS sd_days_bet_change,
       avg(ranks_bumped) AS avg_ranks_bumped, stddev_samp(ranks_bumped) AS sd_ranks_bumped,
       avg(abs(ranks_bumped)) AS avg_abs_ranks_bumped, stddev_samp(abs(ranks_bumped)) AS sd_abs_ranks_bumped,
       avg(CASE WHEN price_inc = 1 THEN abs(pct_change) END) AS avg_pct_inc,
       avg(CASE WHEN price_dec = 1 THEN abs(pct_change) END) AS avg_pct_dec,
       avg(abs(pct_change)) AS avg_pct_change, avg(abs(price2_change)) AS avg_price_change
FROM changes GROUP BY seller
"""
BLOCKS["targets"] = """
SELECT seller, avg(rank) AS avg_tgt_rank, stddev_samp(rank) AS sd_tgt_rank,
       coalesce(avg(pct_diff_next_lowest), 0) AS avg_tgt_pct_diff_next_lowest,
       coalesce(avg(pct_diff_next_highest), 0) AS avg_tgt_pct_diff_next_highest,
       coalesce(avg(pct_diff_lowest), 0) AS avg_tgt_pct_diff_lowest,
       avg(pct_diff_anchor) AS avg_tgt_pct_diff_anchor
FROM changes GROUP BY seller
"""
BLOCKS["listing_counts"] = "SELECT seller, count(DISTINCT isbn) AS num_listings FROM panel GROUP BY seller"
BLOCKS["synch"] = "SELECT dateacc, seller, count(*) AS num_same_day_change FROM changes GROUP BY ALL"
BLOCKS["mean_synch"] = "SELECT seller, avg(num_same_day_change) AS avg_num_same_day_change FROM synch GROUP BY seller"
BLOCKS["ratings"] = "SELECT seller, avg(rating) AS avg_rating, avg(numrating) AS avg_num_rating FROM panel GROUP BY seller"
BLOCKS["profile"] = """
SELECT *, avg_num_same_day_change / nullif(num_listings, 0) AS avg_pct_inventory_changed,
       listings_no_change / nullif(num_listings, 0) AS pct_listings_no_change
FROM listing_counts JOIN totals USING (seller) LEFT JOIN moments USING (seller) LEFT JOIN targets USING (seller)
LEFT JOIN mean_synch USING (seller) JOIN ratings USING (seller)
"""
BLOCKS["profiles"] = """
SELECT dateacc, isbn, reviews, book_rating, CASE WHEN reviews % 11 <> 0 THEN place END AS sales_rank
FROM (SELECT *, row_number() OVER (PARTITION BY dateacc ORDER BY quantity DESC, isbn) AS place
      FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dateacc, p_brand AS isbn, count(*) AS reviews,
                   avg(l_quantity) / 10 AS book_rating, sum(l_quantity) AS quantity
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))
"""
BLOCKS["product_master"] = """
SELECT DISTINCT p_brand AS isbn, concat('SOURCE', CAST(CAST(substring(p_brand, 7) AS INT) % 3 AS VARCHAR)) AS source
FROM part WHERE CAST(substring(p_brand, 7) AS INT) % 13 <> 0
"""
BLOCKS["bestsellers"] = """
SELECT p_type AS display_name, p_brand AS isbn FROM part WHERE CAST(substring(p_brand, 7) AS INT) < 15
"""
BLOCKS["clusters"] = f"""
SELECT CASE WHEN s_suppkey = 1 THEN '{ANCHOR}' ELSE concat('S', CAST(s_suppkey AS VARCHAR)) END AS seller,
       CAST(s_suppkey % 3 + 1 AS INT) AS cluster
FROM supplier WHERE s_suppkey % 5 <> 0
"""
BLOCKS["unranked"] = f"""
SELECT DISTINCT isbn FROM profiles
WHERE dateacc IN ({", ".join(f"DATE '{d}'" for d in CHECK_DAYS)}) AND sales_rank IS NULL
"""
BLOCKS["eligible"] = """
SELECT * FROM panel WHERE isbn NOT IN (SELECT isbn FROM unranked) AND isbn IN (SELECT isbn FROM product_master)
"""
ROBUST = f"(coalesce(numrating >= 415 AND rank < 10, false) OR seller = '{ANCHOR}')"
BLOCKS["days_joined"] = f"""
SELECT l.isbn, l.dateacc, l.seller AS seller_lowest, l.price2 AS price_lowest, a.price2 AS price_anchor,
       price_lowest_minrat, price_lowest_avg3
FROM (SELECT * FROM eligible WHERE rank = 1) l
JOIN (SELECT * FROM eligible WHERE seller = '{ANCHOR}') a ON l.isbn = a.isbn AND l.dateacc = a.dateacc
JOIN (SELECT isbn, dateacc, min(price2) AS price_lowest_minrat FROM eligible WHERE {ROBUST} GROUP BY ALL) m
  ON l.isbn = m.isbn AND l.dateacc = m.dateacc
JOIN (SELECT isbn, dateacc, avg(price2) AS price_lowest_avg3 FROM eligible WHERE rank <= 3 GROUP BY ALL) v
  ON l.isbn = v.isbn AND l.dateacc = v.dateacc
"""
BLOCKS["weighted_days"] = """
SELECT d.*, reviews, book_rating, sales_rank,
       coalesce(date_diff('day', lag(d.dateacc) OVER (PARTITION BY d.isbn ORDER BY d.dateacc), d.dateacc), 1) AS days_bet
FROM days_joined d LEFT JOIN profiles p ON d.isbn = p.isbn AND d.dateacc = p.dateacc
"""
SPREAD = ["price_lowest", "sales_rank", "price_anchor", "price_lowest_minrat", "price_lowest_avg3"]
BLOCKS["variability"] = f"""
SELECT *, (price_lowest_max - price_lowest_min) / nullif(price_lowest_min, 0) AS pct_diff_max_min,
       sd_lowest / nullif(mean_lowest, 0) AS coeff_var, sd_price_anchor / nullif(avg_price_anchor, 0) AS coeff_var_anchor,
       (price_lowest_minrat_max - price_lowest_minrat_min) / nullif(price_lowest_minrat_min, 0) AS pct_diff_minrat,
       sd_minrat / nullif(mean_minrat, 0) AS coeff_var_minrat, sd_avg3 / nullif(mean_avg3, 0) AS coeff_var_avg3
FROM (
  SELECT isbn, min(price_lowest) AS price_lowest_min, max(price_lowest) AS price_lowest_max,
         {wmean("price_lowest", "days_bet")} AS mean_lowest, {wsd("price_lowest", "days_bet", "isbn")} AS sd_lowest,
         avg(reviews) AS avg_num_reviews, avg(book_rating) AS avg_ratings,
         {wmean("sales_rank", "days_bet")} AS avg_sales_rank, {wsd("sales_rank", "days_bet", "isbn")} AS sd_sales_rank,
         {wmean("price_anchor", "days_bet")} AS avg_price_anchor, {wsd("price_anchor", "days_bet", "isbn")} AS sd_price_anchor,
         min(price_lowest_minrat) AS price_lowest_minrat_min, max(price_lowest_minrat) AS price_lowest_minrat_max,
         {wmean("price_lowest_minrat", "days_bet")} AS mean_minrat, {wsd("price_lowest_minrat", "days_bet", "isbn")} AS sd_minrat,
         {wmean("price_lowest_avg3", "days_bet")} AS mean_avg3, {wsd("price_lowest_avg3", "days_bet", "isbn")} AS sd_avg3
  FROM (SELECT *, {", ".join(centre(x, "days_bet", "isbn") for x in SPREAD)} FROM weighted_days)
  GROUP BY isbn
) WHERE price_lowest_min > 0.1
"""
BLOCKS["day_sellers"] = f"""
SELECT isbn, dateacc, count(*) AS num_sellers,
       sum(CASE WHEN coalesce(numrating >= 415, false) OR seller = '{ANCHOR}' THEN 1 ELSE 0 END) AS num_sellers_minrat,
       sum(CASE WHEN seller = '{ANCHOR}' THEN 1 ELSE fba END) AS num_fba
FROM eligible GROUP BY ALL
"""
BLOCKS["mean_sellers"] = """
SELECT isbn, avg(num_sellers) AS num_sellers, avg(num_sellers_minrat) AS num_sellers_minrat, avg(num_fba) AS num_fba
FROM day_sellers GROUP BY isbn
"""
BLOCKS["mean_clusters"] = """
SELECT isbn, avg(c1) AS c1, avg(c2) AS c2, avg(c3) AS c3
FROM (SELECT isbn, dateacc, count(*) FILTER (WHERE cluster = 1) AS c1, count(*) FILTER (WHERE cluster = 2) AS c2,
             count(*) FILTER (WHERE cluster = 3) AS c3
      FROM eligible JOIN clusters USING (seller) GROUP BY ALL)
GROUP BY isbn
"""
BLOCKS["mean_excluded"] = """
SELECT isbn, avg(n) AS num_sellers_excluded
FROM (SELECT isbn, dateacc, count(*) AS n FROM eligible WHERE seller NOT IN (SELECT seller FROM clusters) GROUP BY ALL)
GROUP BY isbn
"""
BLOCKS["moved"] = """
SELECT isbn, dateacc, count(*) AS num_ranked, sum(moved) AS displaced
FROM (SELECT isbn, dateacc,
             CASE WHEN seller <> lag(seller) OVER w THEN 1 WHEN lag(seller) OVER w IS NOT NULL THEN 0 END AS moved
      FROM eligible WHERE rank <= 15 WINDOW w AS (PARTITION BY isbn, rank ORDER BY dateacc))
WHERE moved IS NOT NULL GROUP BY ALL
"""
BLOCKS["mean_moved"] = f"""
SELECT isbn, {wmean("displaced", "days_bet")} AS avg_displaced
FROM weighted_days LEFT JOIN moved USING (isbn, dateacc) GROUP BY isbn
"""
BLOCKS["attributes"] = """
SELECT p.isbn, coalesce(b.display_name, m.source) AS display_name, l.list_price, l.format
FROM (SELECT DISTINCT p_brand AS isbn FROM part) p LEFT JOIN product_master m ON p.isbn = m.isbn
LEFT JOIN (SELECT isbn, min(display_name) AS display_name FROM bestsellers GROUP BY isbn) b ON p.isbn = b.isbn
LEFT JOIN list_prices l ON p.isbn = l.isbn
"""
BLOCKS["fluctuation"] = """
SELECT v.isbn, num_sellers, num_sellers_minrat, num_fba, c1, c2, c3, num_sellers_excluded,
       price_lowest_min, price_lowest_max, mean_lowest, coalesce(sd_lowest, 0) AS sd_lowest, avg_num_reviews, avg_ratings,
       avg_sales_rank, coalesce(sd_sales_rank, 0) AS sd_sales_rank, avg_price_anchor,
       coalesce(sd_price_anchor, 0) AS sd_price_anchor, CASE WHEN sd_price_anchor IS NULL THEN 1 ELSE 0 END AS no_anchor_change,
       price_lowest_minrat_min, price_lowest_minrat_max, mean_minrat, sd_minrat, mean_avg3, sd_avg3,
       pct_diff_max_min, coalesce(coeff_var, 0) AS coeff_var, coalesce(coeff_var_anchor, 0) AS coeff_var_anchor,
       pct_diff_minrat, coeff_var_minrat, coeff_var_avg3, display_name, coalesce(list_price, 0) AS list_price, format,
       CASE WHEN list_price IS NULL THEN 1 ELSE 0 END AS no_list_price, avg_displaced
FROM variability v JOIN mean_sellers USING (isbn) LEFT JOIN mean_clusters USING (isbn) LEFT JOIN mean_excluded USING (isbn)
LEFT JOIN attributes USING (isbn) JOIN mean_moved USING (isbn)
"""
BLOCKS["paired_days"] = f"""
SELECT l.isbn, l.dateacc, l.price2 AS price_lowest, a.price2 AS price_anchor
FROM (SELECT * FROM panel WHERE rank = 1) l JOIN (SELECT * FROM panel WHERE seller = '{ANCHOR}') a
  ON l.isbn = a.isbn AND l.dateacc = a.dateacc
"""
BLOCKS["weekly"] = """
SELECT isbn, CAST(floor((date_diff('day', (SELECT min(dateacc) FROM paired_days), dateacc) + 2) / 7 + 1) AS INT) AS week_elapsed,
       avg(price_anchor) AS avg_price_anchor, avg(price_lowest) AS avg_price_lowest
FROM paired_days GROUP BY ALL
"""
BLOCKS["weeks_filled"] = """
SELECT isbn, week_elapsed,
       last_value(avg_price_anchor IGNORE NULLS) OVER w AS avg_price_anchor,
       last_value(avg_price_lowest IGNORE NULLS) OVER w AS avg_price_lowest
FROM (SELECT isbn, unnest(generate_series(1, (SELECT max(week_elapsed) FROM weekly))) AS week_elapsed
      FROM (SELECT DISTINCT isbn FROM weekly)) LEFT JOIN weekly USING (isbn, week_elapsed)
WINDOW w AS (PARTITION BY isbn ORDER BY week_elapsed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
BLOCKS["weekly_kept"] = """
SELECT * FROM weeks_filled
WHERE isbn IN (SELECT isbn FROM weeks_filled GROUP BY isbn HAVING count(avg_price_anchor) >= 10)
"""
BLOCKS["initial_changes"] = """
SELECT *, ln(avg_price_anchor) - ln(first_value(avg_price_anchor) OVER w) AS anchor_initial_change,
       ln(avg_price_lowest) - ln(first_value(avg_price_lowest) OVER w) AS lowest_initial_change
FROM weekly_kept WHERE avg_price_anchor IS NOT NULL WINDOW w AS (PARTITION BY isbn ORDER BY week_elapsed)
"""
BLOCKS["returns"] = """
SELECT * FROM (
  SELECT isbn, dateacc, ln(price_lowest) - ln(lag(price_lowest) OVER w) AS log_diff_lowest,
         ln(price_anchor) - ln(lag(price_anchor) OVER w) AS log_diff_anchor,
         ln(sales_rank) - ln(lag(sales_rank) OVER w) AS log_diff_rank, lag(dateacc) OVER w AS before
  FROM paired_days LEFT JOIN profiles USING (isbn, dateacc) WINDOW w AS (PARTITION BY isbn ORDER BY dateacc)
) WHERE before IS NOT NULL
"""
BLOCKS["weighted_panel"] = f"""
SELECT *, {centre("price2", "w", "seller, isbn")} FROM (SELECT *, coalesce(days_bet, 1) AS w FROM panel)
"""
BLOCKS["pair_prices"] = f"""
SELECT seller, isbn, {wsd("price2", "w", "")} AS price_stdev, {wmean("price2", "w")} AS price_mean,
       {wmean("rank", "w")} AS rank_mean, sum(w) AS days_observed, count(DISTINCT price2) AS num_unique_price,
       max(price2) AS price_max, min(price2) AS price_min
FROM weighted_panel GROUP BY seller, isbn
"""
BLOCKS["features_of_pairs"] = """
SELECT p.*, price_stdev / nullif(price_mean, 0) AS coeff_var, ln(price_max) - ln(price_min) AS price_range,
       coalesce(t, 0) AS avg_tgt_rank, coalesce(g, 0) AS avg_days_bet_change, coalesce(c, 0) AS avg_pct_change,
       coalesce(i, 0) AS num_increase, coalesce(d, 0) AS num_decrease, coalesce(b, 0) AS avg_ranks_bumped,
       coalesce(i + d, 0) AS num_change
FROM pair_prices p LEFT JOIN (
  SELECT seller, isbn, avg(rank) AS t, avg(days_bet_change) AS g, avg(abs(pct_change)) AS c, sum(price_inc) AS i,
         sum(price_dec) AS d, avg(ranks_bumped) AS b FROM changes GROUP BY seller, isbn
) x ON p.seller = x.seller AND p.isbn = x.isbn
"""
BLOCKS["sellers_active"] = """
SELECT seller, cluster, avg_tgt_rank, avg_days_bet_change, avg_abs_ranks_bumped, avg_pct_change, avg_pct_inventory_changed,
       num_price_change,
       CASE WHEN avg_tgt_rank + 0.01 > 0 THEN ln(avg_tgt_rank + 0.01) END AS log_avg_tgt_rank,
       CASE WHEN avg_pct_inventory_changed > 0 THEN ln(avg_pct_inventory_changed) END AS log_avg_pct_inventory_changed,
       CASE WHEN avg_days_bet_change + 0.01 > 0 THEN ln(avg_days_bet_change + 0.01) END AS log_avg_days_bet_change,
       CASE WHEN avg_abs_ranks_bumped + 0.01 > 0 THEN ln(avg_abs_ranks_bumped + 0.01) END AS log_avg_abs_ranks_bumped,
       CASE WHEN avg_pct_change > 0 THEN ln(avg_pct_change) END AS log_avg_pct_change,
       CASE WHEN sd_days_bet_change + 0.01 > 0 THEN ln(sd_days_bet_change + 0.01) END AS log_sd_days_bet_change,
       CASE WHEN avg_rating + 0.01 > 0 THEN ln(avg_rating + 0.01) END AS log_avg_rating,
       CASE WHEN avg_num_rating + 0.01 > 0 THEN ln(avg_num_rating + 0.01) END AS log_avg_num_rating,
       CASE WHEN avg_days_observed > 0 THEN ln(avg_days_observed) END AS log_avg_days_observed,
       CASE WHEN avg_pct_first_page > 0 THEN ln(avg_pct_first_page) END AS log_avg_pct_first_page
FROM profile LEFT JOIN clusters USING (seller) WHERE num_price_change > 0
"""
CLASSIFY = ["log_avg_tgt_rank", "log_avg_pct_inventory_changed", "log_avg_days_bet_change",
            "log_avg_abs_ranks_bumped", "log_avg_pct_change"]
BLOCKS["sellers_complete"] = f"SELECT * FROM sellers_active WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CLASSIFY)}"
BLOCKS["standardized"] = f"""
SELECT seller, cluster, {", ".join(
    f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS {c}" for c in CLASSIFY)}
FROM sellers_complete
"""
BLOCKS["descriptions"] = rf"""
SELECT source AS seller, doc_id AS isbn, CAST(doc_id % 2 AS INT) AS used, text,
       regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
         '&#171;Show less.+&#187;Read more', ' ', 'g'), '{PUNCT}', ' ', 'g'),
         '({SPACE})', '\1\1', 'g'), '{SPACE}[0-9]+{SPACE}', ' ', 'g')), '{SPACE}+', ' ', 'g') AS comments,
       CASE lang WHEN 'en' THEN 'United States' WHEN 'fr' THEN 'Maine, United States' WHEN 'de' THEN 'United Kingdom' ELSE 'Spain' END AS shipsfrom
FROM documents
"""
BLOCKS["words"] = """
SELECT isbn, unnest(list_words) AS word, generate_subscripts(list_words, 1) AS place
FROM (SELECT isbn, string_split(trim(comments), ' ') AS list_words FROM descriptions WHERE trim(comments) <> '')
"""
BLOCKS["all_grams"] = """
SELECT 2 AS n, concat(word, ' ', b) AS gram FROM (
  SELECT word, lead(word) OVER (PARTITION BY isbn ORDER BY place) AS b FROM words) WHERE b IS NOT NULL
UNION ALL
SELECT 3, concat(word, ' ', b, ' ', c) FROM (
  SELECT word, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM words
  WINDOW w AS (PARTITION BY isbn ORDER BY place)) WHERE c IS NOT NULL
"""
BLOCKS["top_grams"] = """
SELECT n, gram, count(*) AS count FROM all_grams GROUP BY n, gram
QUALIFY row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, gram) <= 60
"""
BLOCKS["phrases"] = "SELECT DISTINCT gram FROM top_grams WHERE length(gram) % 2 = 1"
BLOCKS["phrase_hits"] = """
SELECT d.seller, d.isbn, d.used, d.comments, count(gram) AS phrase_count,
       coalesce(string_agg(gram, '|' ORDER BY gram), '') AS phrases,
       CASE WHEN count(gram) > 0 THEN 1 ELSE 0 END AS informative
FROM descriptions d LEFT JOIN phrases p ON contains(d.comments, p.gram) GROUP BY d.seller, d.isbn, d.used, d.comments
"""
BLOCKS["repeats"] = """
SELECT seller, isbn, used, comments,
       CASE WHEN row_number() OVER (PARTITION BY seller, comments ORDER BY isbn, used) > 1 THEN 1 ELSE 0 END AS repeat_comment
FROM descriptions
"""
BLOCKS["product_pages"] = f"SELECT page_id, html AS source_html, {PRODUCT_PAGE} AS html FROM pages"
BLOCKS["offer_pages"] = f"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS item, {OFFER_PAGE} AS html FROM pages"


def inner(block: str, tag: str, mark: str) -> str:
    return (
        f"trim(regexp_replace(nullif(regexp_extract({block}, '(?s)(<{tag}[^>]*class=\"{mark}\"[^>]*>.*?)</{tag}>', 1), ''),"
        " '<[^>]*>', '', 'g'))"
    )


def dollars(text: str) -> str:
    return rf"try_cast(replace(regexp_replace({text}, '[+$\s]', '', 'g'), ',', '') AS DOUBLE)"


BLOCKS["offer_blocks"] = """
SELECT page_id, item, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS pos
FROM (SELECT page_id, item, regexp_extract_all(html, '(?s)<tbody[^>]*class="result"[^>]*>(.*?)</tbody>', 1) AS blocks FROM offer_pages)
"""
BLOCKS["offers"] = rf"""
SELECT page_id, item, pos, {dollars(inner("block", "span", "price"))} AS price, {inner("block", "div", "condition")} AS "condition",
       CASE WHEN anchored_block THEN '{ANCHOR}' ELSE trim(split_part({inner("block", "div", "seller")}, ':', 2)) END AS seller,
       CASE WHEN NOT anchored_block AND NOT contains(rated, 'Just Launched') THEN nullif(regexp_extract(rated, '(\d+%)', 1), '') END AS rating,
       CASE WHEN NOT anchored_block THEN CASE WHEN contains(rated, 'Just Launched') THEN '0' WHEN contains(rated, '1 rating') THEN '1'
            ELSE nullif(regexp_extract(rated, '([\d,]+) total ratings', 1), '') END END AS numrating,
       CASE WHEN anchored_block OR filled THEN 1 ELSE 0 END AS fba,
       CASE WHEN anchored_block OR filled THEN 0.0 ELSE {dollars(inner("block", "span", "price_shipping"))} END AS shipping,
       CASE WHEN NOT anchored_block THEN {inner("block", "div", "comments")} END AS comments,
       CASE WHEN NOT anchored_block THEN nullif(regexp_extract({inner("block", "div", "availability")}, 'Ships from ([\w,\s]+).', 1), '') END AS shipsfrom
FROM (SELECT *, contains(block, 'alt="{ANCHOR}"') AS anchored_block, {inner("block", "div", "rating")} AS rated,
             {inner("block", "div", "fba_link")} IS NOT NULL AS filled FROM offer_blocks)
"""
BLOCKS["snapshots"] = """
SELECT CAST(ts AS DATE) AS dateacc, event_type AS isbn, user_id AS seller, ts, event_id, value FROM events
"""
BLOCKS["ticks"] = "SELECT user_id AS seller, event_type AS isbn, ts, event_id, CAST(floor(value / 10) * 10 AS DOUBLE) AS price2 FROM events"
