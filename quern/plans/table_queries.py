"""Queries on cleaning, scalars, calendars, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggs, calendar_dim, clean, joins, windows
from .registry import query
from .tables import cte, table

HOUSES, RECIPES, RUNS, FIRES, PROPS = cte("houses"), cte("recipes"), cte("runs"), cte("fires"), cte("properties")


# --- cleaning


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def select_renamed(spark, d):
    return clean.select_renamed(table(spark, d, "customer"), {"c_custkey": "id", "c_mktsegment": "segment", "c_acctbal": "balance"}, ["id", "segment", "balance"])


@query(f"WITH {HOUSES} SELECT house_id, coalesce(city, 'Unknown') AS city, coalesce(sale_price, 0) AS sale_price FROM houses")
def fill_constant(spark, d):
    return clean.fill_constant(table(spark, d, "houses"), {"city": "Unknown", "sale_price": 0}).select("house_id", "city", "sale_price")


@query(f"WITH {RECIPES} SELECT recipe, calories, protein FROM recipes WHERE calories IS NOT NULL AND protein IS NOT NULL")
def drop_missing(spark, d):
    return clean.drop_missing(table(spark, d, "recipes").select("recipe", "calories", "protein"))


@query(f"""WITH {HOUSES}, m AS (SELECT round_even(avg(months_listed), 1) AS a, round_even(avg(bedrooms), 0) AS b FROM houses)
    SELECT house_id, coalesce(months_listed, a) AS months_listed, coalesce(bedrooms, cast(b AS int)) AS bedrooms FROM houses, m""")
def fill_mean(spark, d):
    return clean.fill_mean(table(spark, d, "houses").select("house_id", "months_listed", "bedrooms"), {"months_listed": 1, "bedrooms": 0})


@query(f"""WITH {HOUSES}, m AS (SELECT house_type AS t FROM houses WHERE house_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT house_id, coalesce(house_type, t) AS house_type FROM houses, m""")
def fill_mode(spark, d):
    return clean.fill_mode(table(spark, d, "houses").select("house_id", "house_type"), "house_type")


@query(f"""WITH {HOUSES} SELECT house_id, CASE house_type WHEN 'Det.' THEN 'Detached' WHEN 'Semi' THEN 'Semi-detached' WHEN 'Terr.' THEN 'Terraced' ELSE house_type END AS house_type FROM houses""")
def canonicalize(spark, d):
    return clean.canonicalize(table(spark, d, "houses").select("house_id", "house_type"), "house_type", clean.HOUSE_SPELLINGS)


@query(f"WITH {RECIPES} SELECT recipe, CASE WHEN category IN ({', '.join(repr(c) for c in clean.RECIPE_CATEGORIES)}) THEN category END AS category FROM recipes")
def enforce_domain(spark, d):
    return clean.enforce_domain(table(spark, d, "recipes").select("recipe", "category"), "category", clean.RECIPE_CATEGORIES)


@query(f"WITH {HOUSES} SELECT house_id, try_cast(trim(replace(area, 'sq.m.', '')) AS double) AS area FROM houses")
def parse_number(spark, d):
    return clean.parse_number(table(spark, d, "houses").select("house_id", "area"), "area", "sq.m.")


@query(f"WITH {HOUSES} SELECT count(*) AS n_invalid FROM houses WHERE house_type IS NULL OR house_type NOT IN ('Detached', 'Semi-detached', 'Terraced')")
def count_invalid(spark, d):
    return clean.count_invalid(table(spark, d, "houses"), "house_type", clean.HOUSE_TYPES)


@query(f"WITH {HOUSES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM houses" for c in ("city", "sale_price", "sale_date", "months_listed", "bedrooms", "house_type", "area")))
def missing_report(spark, d):
    return clean.missing_report(table(spark, d, "houses").drop("house_id"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000 AND NOT o_orderpriority = '5-LOW'")
def predicates(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 50000) & ~(F.col("o_orderpriority") == "5-LOW"))
    return rows.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(f"""WITH {RUNS}, x AS (SELECT event_id, v, unnest([0.0, 90.0, 180.0, 270.0, 360.0])::double AS snap, deg FROM runs)
    SELECT event_id, v, snap AS deg FROM x WHERE abs(x.deg - snap) < 2""")
def snap_to_targets(spark, d):
    return clean.snap_to_targets(table(spark, d, "runs").select("event_id", "v", "deg"), "deg", (0, 90, 180, 270, 360), 2.0)


@query(f"""WITH {PROPS}, r AS (SELECT *, row_number() OVER (PARTITION BY round(lon, 1), round(lat, 1) ORDER BY lon, lat, prop_id) AS k FROM properties) SELECT prop_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM r WHERE k = 1""")
def dedupe_points(spark, d):
    one = clean.dedupe_points(table(spark, d, "properties").select("lon", "lat", "prop_id"), digits=1)
    return one.select("prop_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH RECURSIVE {PROPS}, w AS (SELECT prop_id, lon, lat, cast(round(lon * 500) AS bigint) AS i, cast(round(lat * 800) AS bigint) AS j FROM properties WHERE nation = 3),
    l AS (SELECT a.prop_id AS a, b.prop_id AS b FROM w a JOIN w b ON abs(a.i - b.i) <= 150 AND abs(a.j - b.j) <= 240),
    reach(a, b) AS (SELECT prop_id, prop_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
    g AS (SELECT a, min((lon, lat)) AS place FROM reach JOIN w ON w.prop_id = b GROUP BY a)
    SELECT a AS prop_id, round(place[1], 6) AS lon, round(place[2], 6) AS lat FROM g""")
def near_equal_places(spark, d):
    """The least place of each property's group: places of one nation that steps of 0.3 degrees in either coordinate join. SQL compares all pairs in whole steps of the grid that the places lie on."""
    found = clean.near_equal_groups(table(spark, d, "properties").where("nation = 3"), 0.3001)
    return found.select("prop_id", F.round("place.lon", 6).alias("lon"), F.round("place.lat", 6).alias("lat"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_keys(spark, d):
    return clean.distinct_keys(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c_custkey, sha256(lower(trim(c_name)) || '|' || cast(c_nationkey AS varchar)) AS address_id FROM customer")
def address_hash(spark, d):
    return clean.address_hash(table(spark, d, "customer"), ["c_name", "c_nationkey"]).select("c_custkey", "address_id")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, 1 AS times FROM customer")
def sample_and_rest(spark, d):
    """A sampling operator: the 100 rows of a sample and those that it leaves are the table, each row once."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    both = clean.sample_n(rows, "c_custkey", 100, seed=7).unionByName(clean.drop_n(rows, "c_custkey", 100, seed=7))
    return both.groupBy("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal")).agg(F.count(F.lit(1)).cast("int").alias("times"))


@query(f"WITH {PROPS} SELECT prop_id, substr(geoid, 1, 2) AS state_id FROM properties WHERE substr(geoid, 1, 2) = '04'")
def by_state(spark, d):
    return clean.by_state(sc.geoid_parts(table(spark, d, "properties")), "04").select("prop_id", "state_id")


@query("SELECT p_partkey, p_name, p_brand FROM part")
def drop_cols(spark, d):
    return clean.drop_cols(table(spark, d, "part"), ["p_type", "p_size", "p_retailprice"])


@query(f"""WITH {HOUSES}, k AS (SELECT * FROM houses WHERE sale_price IS NOT NULL),
    c AS (SELECT house_id, CASE WHEN city IS NULL OR city = '--' THEN 'Unknown' ELSE city END AS city, sale_price, coalesce(cast(sale_date AS date), DATE '2023-01-01') AS sale_date, months_listed, bedrooms,
        CASE house_type WHEN 'Det.' THEN 'Detached' WHEN 'Semi' THEN 'Semi-detached' WHEN 'Terr.' THEN 'Terraced' ELSE house_type END AS house_type, try_cast(trim(replace(area, 'sq.m.', '')) AS double) AS area FROM k),
    m AS (SELECT round_even(avg(months_listed), 1) AS a, round_even(avg(bedrooms), 0) AS b, round_even(avg(area), 1) AS r FROM c),
    t AS (SELECT house_type AS t FROM c WHERE house_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT house_id, city, sale_price, sale_date, coalesce(months_listed, a) AS months_listed, coalesce(bedrooms, cast(b AS int)) AS bedrooms, coalesce(house_type, t) AS house_type, coalesce(area, r) AS area FROM c, m, t""")
def clean_houses(spark, d):
    return clean.clean_houses(table(spark, d, "houses"))


@query(f"""WITH {RECIPES} SELECT recipe, calories, protein, CASE WHEN c IN ({', '.join(repr(c) for c in clean.RECIPE_CATEGORIES)}) THEN c END AS category, cast(regexp_extract(servings, '^\\s*(\\d+)', 1) AS int) AS servings, coalesce(high_traffic, 'Low') AS high_traffic
    FROM (SELECT *, CASE WHEN category = 'Chicken Breast' THEN 'Chicken' ELSE category END AS c FROM recipes) WHERE calories IS NOT NULL AND protein IS NOT NULL""")
def clean_recipes(spark, d):
    return clean.clean_recipes(table(spark, d, "recipes"))


# --- scalars


@query("SELECT o_orderkey, cast(year(o_orderdate) AS int) AS year, cast(month(o_orderdate) AS int) AS month, cast(day(o_orderdate) AS int) AS day FROM orders")
def date_parts(spark, d):
    return sc.date_parts(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "year", "month", "day")


@query("SELECT p_partkey, round(ln(p_retailprice), 8) AS log_price FROM part")
def log_col(spark, d):
    return sc.log_col(table(spark, d, "part"), "p_retailprice", "log_price").select("p_partkey", F.round("log_price", 8).alias("log_price"))


@query("""SELECT event_id, round(h / 10000, 8) AS h_t, round(v / 0.002, 6) AS m_emu_cm3, round(v / 0.0185, 6) AS m_emu_g, round(v / 0.0185 * 488.44, 4) AS m_emu_mol, round(v / 0.0185 * 488.44 / 6.0221408e23 * 1.078e20, 8) AS m_mu_b, round(radians(deg), 8) AS rad
    FROM (SELECT event_id, value AS v, cast(event_id % 7 - 3 AS double) AS h, cast(event_id % 360 AS double) AS deg FROM events)""")
def unit_conversions(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "value AS v", "cast(event_id % 7 - 3 AS double) AS h", "cast(event_id % 360 AS double) AS deg")
    out = sc.with_units(rows, "v", "h", mass=0.0185, molar_mass=488.44, volume=0.002)
    digits = {"h_t": 8, "m_emu_cm3": 6, "m_emu_g": 6, "m_emu_mol": 4, "m_mu_b": 8}
    return out.select("event_id", *(F.round(c, n).alias(c) for c, n in digits.items()), F.round(sc.degrees_to_radians("deg"), 8).alias("rad"))


_DEMAG = """(((b*b-c*c)/(2*b*c)*ln((s-a)/(s+a)) + (a*a-c*c)/(2*a*c)*ln((s-b)/(s+b)) + b/(2*c)*ln((ab+a)/(ab-a)) + a/(2*c)*ln((ab+b)/(ab-b)) + c/(2*a)*ln((bc-b)/(bc+b)) + c/(2*b)*ln((ac-a)/(ac+a))
    + 2*atan(a*b/(c*s)) + (a**3+b**3-2*c**3)/(3*a*b*c) + (a*a+b*b-2*c*c)/(3*a*b*c)*s + c/(a*b)*(ac+bc) - (ab**3+bc**3+ac**3)/(3*a*b*c)) / pi())"""


@query(f"""WITH x AS (SELECT p_partkey, p_size / 10.0 AS a, p_partkey % 9 / 4.0 + 0.5 AS b, p_partkey % 13 / 5.0 + 0.4 AS c, p_retailprice AS h, (p_size - 25.0) AS m FROM part),
    y AS (SELECT *, sqrt(a*a+b*b) AS ab, sqrt(b*b+c*c) AS bc, sqrt(a*a+c*c) AS ac, sqrt(a*a+b*b+c*c) AS s FROM x), z AS (SELECT *, {_DEMAG} AS d FROM y)
    SELECT p_partkey, round(d, 8) AS d, round(h + 4 * pi() * (1 - d) * m, 5) AS b_flux FROM z""")
def demag_and_flux(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_size / 10.0D AS a", "p_partkey % 9 / 4.0D + 0.5D AS b", "p_partkey % 13 / 5.0D + 0.4D AS c", "p_retailprice AS h", "p_size - 25.0D AS m")
    out = rows.withColumn("d", sc.demag_factor("a", "b", "c"))
    return out.select("p_partkey", F.round("d", 8).alias("d"), F.round(sc.flux_density("h", "m", "d"), 5).alias("b_flux"))


@query(f"""WITH x AS (SELECT p_partkey, cast(p_partkey % 5 * 90 AS double) AS deg, CASE WHEN p_partkey % 2 = 0 THEN 'para' ELSE 'perp' END AS geo FROM part),
    y AS (SELECT p_partkey, CASE WHEN deg IN (0, 180, 360) THEN 0.3 WHEN geo = 'para' THEN 0.1 ELSE 0.3 END AS a, CASE WHEN deg IN (0, 180, 360) THEN 0.2 WHEN geo = 'para' THEN 0.2 ELSE 0.1 END AS b,
        CASE WHEN deg IN (0, 180, 360) THEN 0.1 WHEN geo = 'para' THEN 0.3 ELSE 0.2 END AS c FROM x),
    z AS (SELECT p_partkey, a::double AS a, b::double AS b, c::double AS c, sqrt(a*a+b*b) AS ab, sqrt(b*b+c*c) AS bc, sqrt(a*a+c*c) AS ac, sqrt(a*a+b*b+c*c) AS s FROM y)
    SELECT p_partkey, round({_DEMAG}, 8) AS d FROM z""")
def oriented_demag(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "cast(p_partkey % 5 * 90 AS double) AS deg", "CASE WHEN p_partkey % 2 = 0 THEN 'para' ELSE 'perp' END AS geo", "0.3D AS l", "0.2D AS w", "0.1D AS h")
    return sc.oriented_demag(rows).select("p_partkey", F.round("d", 8).alias("d"))


@query("""WITH x AS (SELECT p_partkey, p_size / 2.0 + 0.5 AS j, (p_partkey % 41 - 20) / 7.0 AS x, p_retailprice * 10 AS h FROM part),
    y AS (SELECT *, 1.5 + (0.75 - (j - 0.5) * (j + 0.5)) / (2 * j * (j + 1)) AS g FROM x), z AS (SELECT *, g * 9.2740100783e-21 * j AS mu FROM y),
    w AS (SELECT *, mu * (h + 4 * pi() * 0.7 * 20) / (1.380649e-16 * 5) AS u FROM z)
    SELECT p_partkey, round(g, 8) AS g, round(CASE WHEN abs(x) < 1e-4 THEN (j + 1) * x / (3 * j) ELSE (2*j+1)/(2*j)/tanh((2*j+1)/(2*j)*x) - 1/(2*j)/tanh(x/(2*j)) END, 7) AS b_j,
        round(1.5e22 * mu * ((2*j+1)/(2*j)/tanh((2*j+1)/(2*j)*u) - 1/(2*j)/tanh(u/(2*j))) + 0.001 * h, 5) AS m FROM w""")
def brillouin_model(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_size / 2.0D + 0.5D AS j", "(p_partkey % 41 - 20) / 7.0D AS x", "p_retailprice * 10 AS h")
    m = sc.model_magnetization("h", 20, 0.3, 5, "j", 0.001, 1.5e22)
    return rows.select("p_partkey", F.round(sc.lande_g("j"), 8).alias("g"), F.round(sc.brillouin("x", "j"), 7).alias("b_j"), F.round(m, 5).alias("m"))


@query("""SELECT event_id, round(value * (1 + 0.1 * sin(2 * th + 0.3) + 0.05 * sin(4 * th - 0.2)), 8) AS model, round(CASE WHEN p < 0 THEN p + 2 * pi() ELSE p END, 8) AS phase
    FROM (SELECT event_id, value, radians(cast(event_id % 360 AS double)) AS th, atan2(value - 50, cast(event_id % 9 - 4 AS double)) AS p FROM events)""")
def sine_and_phase(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "value", "radians(cast(event_id % 360 AS double)) AS th", "atan2(value - 50, cast(event_id % 9 - 4 AS double)) AS p")
    return rows.select("event_id", F.round(sc.sine_model("th", [0.1, 0.05], [2, 4], [0.3, -0.2], "value"), 8).alias("model"), F.round(sc.positive_phase("p"), 8).alias("phase"))


@query(f"""WITH {PROPS} SELECT prop_id, substr(geoid, 1, 2) AS state_id, substr(geoid, 3, 3) AS county_id, substr(geoid, 6, 6) AS tract_id, substr(geoid, 12, 1) AS block_grp, substr(geoid, 12, 4) AS block_id, geoid AS again FROM properties""")
def geoid_parts(spark, d):
    parts = sc.geoid_parts(table(spark, d, "properties"))
    return parts.select("prop_id", "state_id", "county_id", "tract_id", "block_grp", "block_id", sc.geoid_of("state_id", "county_id", "tract_id", "block_id").alias("again"))


@query(f"""WITH {HOUSES} SELECT house_id, CASE WHEN sale_price > 100000 THEN 'high' ELSE 'low' END AS price_label,
    cast(CASE house_type WHEN 'Detached' THEN 0 WHEN 'Semi-detached' THEN 1 WHEN 'Terraced' THEN 2 END AS int) AS house_type, cast(coalesce(city = 'City0', false) AS int) AS city_City0, cast(coalesce(city = 'City1', false) AS int) AS city_City1 FROM houses""")
def encodings(spark, d):
    rows = sc.label_if(table(spark, d, "houses"), "price_label", F.col("sale_price") > 100000, "high", "low")
    return sc.one_hot(sc.ordinal_encode(rows, "house_type", clean.HOUSE_TYPES), "city", ["City0", "City1"]).select("house_id", "price_label", "house_type", "city_City0", "city_City1")


# --- calendar


_DAYS = "d AS (SELECT cast(unnest(generate_series(make_date(min(year(o_orderdate))::int, 1, 1), make_date(max(year(o_orderdate))::int, 12, 31), INTERVAL 1 DAY)) AS date) AS date FROM orders)"


@query(f"""WITH {_DAYS}, m AS (SELECT date, cast(year(date) AS int) AS y, cast(month(date) AS int) AS mo, cast(quarter(date) AS int) AS q, cast(dayofweek(date) + 1 AS int) AS wd FROM d),
    f AS (SELECT *, cast((mo + 9 - 1) % 12 + 1 AS int) AS fm FROM m)
    SELECT date, y AS year, make_date(y, 1, 1) AS year_start, make_date(y, 12, 31) AS year_end, mo AS month_number, make_date(y, mo, 1) AS month_start, last_day(date) AS month_end, cast(day(last_day(date)) AS int) AS days_in_month,
        y * 100 + mo AS year_month_number, strftime(date, '%Y-%b') AS year_month_name, cast(day(date) AS int) AS day_number, dayname(date) AS day_name, strftime(date, '%a') AS day_name_short, wd AS day_of_week,
        monthname(date) AS month_name, strftime(date, '%b') AS month_name_short, q AS quarter, 'Q' || q AS quarter_name, y * 10 + q AS year_quarter_number, y || ' Q' || q AS year_quarter_name,
        make_date(y, q * 3 - 2, 1) AS quarter_start, last_day(make_date(y, q * 3, 1)) AS quarter_end, cast(ceil((dayofyear(date) + dayofweek(make_date(y, 1, 1))) / 7.0) AS int) AS week_number,
        date - (wd - 1) AS week_start, date + (7 - wd) AS week_end, y + cast((mo + 9) // 13 AS int) AS fiscal_year, cast(ceil(fm / 3.0) AS int) AS fiscal_quarter, fm AS fiscal_month FROM f""")
def date_dimension(spark, d):
    return calendar_dim.date_dimension(table(spark, d, "orders"), "o_orderdate", fiscal_start=4)


@query(f"WITH {_DAYS} SELECT date FROM d")
def calendar_bounds(spark, d):
    return calendar_dim.calendar_bounds(table(spark, d, "orders"), "o_orderdate")


# --- joins


@query(f"""WITH {RUNS}, p AS (SELECT t, round(avg(v), 6) AS j FROM runs WHERE t < 5 GROUP BY t) SELECT event_id, runs.t, v, j FROM runs JOIN p ON runs.t = p.t""")
def join_params(spark, d):
    runs = table(spark, d, "runs")
    params = runs.where("t < 5").groupBy("t").agg(F.round(F.avg("v"), 6).alias("j"))
    return joins.join_params(runs.select("event_id", "t", "v"), params)


@query(f"""WITH {RUNS}, b AS (SELECT run, avg(v) AS v_0 FROM runs WHERE h = 0 GROUP BY run)
    SELECT event_id, round(v_0, 6) AS v_0, round(v - v_0, 6) AS delta_v, round((v - v_0) / nullif(v_0, 0), 6) AS delta_v_ratio, round((v - v_0) / nullif(v_0, 0) * 100, 4) AS delta_v_pct FROM runs LEFT JOIN b USING (run)""")
def delta_vs_baseline(spark, d):
    out = joins.delta_vs_baseline(table(spark, d, "runs"), ["run"], F.col("h") == 0, "v")
    return out.select("event_id", *(F.round(c, n).alias(c) for c, n in (("v_0", 6), ("delta_v", 6), ("delta_v_ratio", 6), ("delta_v_pct", 4))))


@query("""SELECT c_custkey, coalesce(f.name, r.name) AS name FROM (SELECT c_custkey, c_nationkey, c_nationkey % 5 AS r FROM customer) c
    LEFT JOIN (SELECT n_nationkey, n_name AS name FROM nation WHERE n_nationkey % 2 = 0) f ON c.c_nationkey = f.n_nationkey LEFT JOIN (SELECT r_regionkey, r_name AS name FROM region) r ON c.r = r.r_regionkey""")
def join_features(spark, d):
    props = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey AS fine", "c_nationkey % 5 AS coarse")
    fine = table(spark, d, "nation").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS fine", "n_name AS name")
    coarse = table(spark, d, "region").selectExpr("r_regionkey AS coarse", "r_name AS name")
    return joins.join_features(props, fine, coarse, "fine", "coarse", ["name"]).select("c_custkey", "name")


@query("SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def with_lookup(spark, d):
    return joins.with_lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation"), "s_nationkey", "n_nationkey")


@query("SELECT DISTINCT c_mktsegment AS \"table\", u.universe FROM customer JOIN (SELECT c_mktsegment AS k, 'segment of ' || cast(count(*) AS varchar) AS universe FROM customer GROUP BY 1) u ON u.k = c_mktsegment")
def universe_of(spark, d):
    rows = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "table")
    meta = rows.groupBy("table").agg(F.concat(F.lit("segment of "), F.count(F.lit(1))).alias("universe"))
    return joins.universe_of(meta, rows.select("table"))


@query("SELECT o_orderkey, cast(trunc(o_totalprice * 0.9) AS bigint) AS price FROM orders")
def predictions(spark, d):
    return joins.predictions(table(spark, d, "orders").withColumn("prediction", F.col("o_totalprice") * 0.9), "o_orderkey")


# --- aggregates


@query("SELECT p_size AS bedrooms, round_even(avg(p_retailprice), 6) AS avg_price, round_even(var_samp(p_retailprice), 6) AS var_price FROM part GROUP BY p_size")
def mean_var_by(spark, d):
    return aggs.mean_var_by(table(spark, d, "part").withColumnRenamed("p_size", "bedrooms"), "bedrooms", "p_retailprice", digits=6)


@query("SELECT l_returnflag, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY l_returnflag")
def value_counts(spark, d):
    return aggs.value_counts(table(spark, d, "lineitem"), "l_returnflag")


@query("""WITH e AS (SELECT [0, 10, 20, 30, 40, 50]::double[] AS a) SELECT cast(b AS int) AS bin, a[b + 1] AS lo, a[b + 2] AS hi, n FROM e, (SELECT least(4, cast(floor(l_quantity / 10) AS int)) AS b, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1)""")
def histogram(spark, d):
    return aggs.histogram(table(spark, d, "lineitem"), "l_quantity", [0, 10, 20, 30, 40, 50])


@query("""SELECT least(1, cast(floor(l_quantity / 25) AS int)) AS x_bin, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS y_bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2""")
def histogram2d(spark, d):
    return aggs.histogram2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", [0, 25, 50], [0, 0.05, 0.1])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c})::double AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c})::double AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def describe(spark, d):
    out = aggs.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return out.select("column", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd")), "min", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), "max")


@query(f"WITH {RUNS} SELECT run, round(avg(v), 6) AS mean_value, arg_min(v, (deg, event_id)) AS first_value FROM runs GROUP BY run")
def run_baselines(spark, d):
    return aggs.run_baselines(table(spark, d, "runs"), ["run"], "v", "deg", "event_id").withColumn("mean_value", F.round("mean_value", 6))


@query(f"""WITH {RUNS}, b AS (SELECT run, avg(v) AS m, arg_min(v, (deg, event_id)) AS f FROM runs GROUP BY run)
    SELECT event_id, round(v - m, 9) AS delta_mean, round((v - m) / nullif(m, 0), 9) AS delta_mean_ratio, round((v - m) / nullif(m, 0) * 100, 8) AS delta_mean_pct, round(v - f, 9) AS delta_first, round((v - f) / nullif(f, 0), 9) AS delta_first_ratio, round((v - f) / nullif(f, 0) * 100, 8) AS delta_first_pct FROM runs JOIN b USING (run)""")
def relative_deltas(spark, d):
    out = aggs.relative_deltas(table(spark, d, "runs"), ["run"], "v", "deg", "event_id")
    return out.select("event_id", *(F.round(f"delta_{b}{s}", n).alias(f"delta_{b}{s}") for b in ("mean", "first") for s, n in (("", 9), ("_ratio", 9), ("_pct", 8))))


@query(f"""WITH {RUNS}, r AS (SELECT cast(event_id % 10 AS int) AS freq, v / max(v) OVER (PARTITION BY run) AS amp_ratio FROM runs)
    SELECT freq, count(*) AS n, round(sum(amp_ratio), 6) AS total, round(avg(amp_ratio), 6) AS mean FROM r WHERE amp_ratio >= 0.5 GROUP BY freq""")
def dominant_freq_summary(spark, d):
    rows = windows.ratio_to_max(table(spark, d, "runs").selectExpr("run", "cast(event_id % 10 AS int) AS freq", "v"), ["run"], "v")
    return aggs.dominant_freq_summary(rows, 0.5).withColumns({"total": F.round("total", 6), "mean": F.round("mean", 6)})


@query("SELECT c_mktsegment, n, round(100.0 * n / nullif(total, 0), 6) AS pct FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) JOIN (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY 1) USING (c_nationkey)")
def percent_of_universe(spark, d):
    rows = table(spark, d, "customer")
    counts = rows.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("universe_total"))
    return aggs.percent_of_universe(counts, totals, ["c_nationkey"], "n").select("c_mktsegment", "n", F.round("pct", 6).alias("pct"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 8) AS rate FROM customer GROUP BY 1, 2")
def rate_by(spark, d):
    return aggs.rate_by(table(spark, d, "customer"), F.col("c_acctbal") < 0, ["c_nationkey", "c_mktsegment"]).withColumn("rate", F.round("rate", 8))


@query(f"WITH {RUNS} SELECT act, max(v) AS max_value, cast(list_sort(list(DISTINCT t)) AS varchar) AS listed FROM runs GROUP BY act")
def group_extent(spark, d):
    return aggs.group_extent(table(spark, d, "runs"), ["act"], "v", "t").withColumn("listed", F.concat(F.lit("["), F.array_join(F.transform("listed", lambda x: x.cast("string")), ", "), F.lit("]")))


@query(f"""WITH {RUNS}, s AS (SELECT t, run, abs(h) AS abs_h, (avg(CASE WHEN h >= 0 THEN v END) + avg(CASE WHEN h <= 0 THEN v END)) / 2 AS sym_value FROM runs GROUP BY ALL)
    SELECT t, run, abs_h, round(sym_value, 6) AS sym_value FROM s WHERE sym_value IS NOT NULL""")
def symmetrize(spark, d):
    return aggs.symmetrize(table(spark, d, "runs"), ["t", "run"], "h", "v").withColumn("sym_value", F.round("sym_value", 6))


@query(f"WITH {FIRES} SELECT cast(year(acq_date) AS int) AS year, sat_id, count(*) AS n FROM fires WHERE type = 0 AND confidence = 'h' GROUP BY 1, 2")
def fires_by_year(spark, d):
    return aggs.fires_by_year(table(spark, d, "fires"))


@query("SELECT round(sqrt(avg(power(l_extendedprice - l_quantity * 1500, 2))), 4) AS rmse FROM lineitem")
def rmse(spark, d):
    return aggs.rmse(table(spark, d, "lineitem").withColumn("hat", F.col("l_quantity") * 1500), "l_extendedprice", "hat").select(F.round("rmse", 4).alias("rmse"))


@query("""SELECT period, round(p, 8) AS precision, p < 0.6 AS below_floor FROM (SELECT l_linestatus AS period, sum(CASE WHEN l_quantity > 25 AND l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 0) AS p FROM lineitem GROUP BY 1)""")
def precision_kpi(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_linestatus AS period", "cast(l_returnflag = 'R' AS int) AS y", "cast(l_quantity > 25 AS int) AS hat")
    return aggs.precision_kpi(rows, "y", "hat", "period").withColumn("precision", F.round("precision", 8))


@query("SELECT round(2 * avg(CASE WHEN l_linenumber - 1 = 0 THEN mu ELSE (l_linenumber - 1) * ln((l_linenumber - 1) / mu) - (l_linenumber - 1) + mu END), 8) AS poisson_deviance FROM (SELECT l_linenumber, l_quantity / 10 + 0.5 AS mu FROM lineitem)")
def poisson_deviance(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("cast(l_linenumber - 1 AS double) AS y", "l_quantity / 10 + 0.5D AS mu")
    return aggs.poisson_deviance(rows, "y", "mu").select(F.round("poisson_deviance", 8).alias("poisson_deviance"))


# --- windows


_EXPERIMENTS = "x AS (SELECT act, t, h, deg, res, b, d FROM (SELECT event_type AS act, cast(user_id % 4 AS int) AS t, cast(user_id % 3 AS double) AS h, cast(event_id % 3 * 90 AS double) AS deg, avg(value) AS res, avg(value) * 2 + cast(event_id % 3 AS double) AS b, 0.2 + (event_id % 3) * 0.1 AS d FROM events GROUP BY event_type, user_id % 4, user_id % 3, event_id % 3))"


@query(f"""WITH {_EXPERIMENTS}, w AS (SELECT *, lag(res) OVER k AS res0, lag(b) OVER k AS b0, lag(d) OVER k AS d0 FROM x WINDOW k AS (PARTITION BY act, t, h ORDER BY deg))
    SELECT act, t, h, round(res - res0, 6) AS delta_res, round((res + res0) / 2, 6) AS mean_res, round((res - res0) / 2, 6) AS amp_res, round((res - res0) / (res + res0) * 100, 5) AS a_dem_pct, round(b - b0, 6) AS delta_b, round(d / d0, 6) AS d_ratio FROM w WHERE deg = 180""")
def demag_amplitudes(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("act"), (F.col("user_id") % 4).cast("int").alias("t"), (F.col("user_id") % 3).cast("double").alias("h"), (F.col("event_id") % 3).alias("k")).agg(F.avg("value").alias("res"))
    rows = rows.selectExpr("act", "t", "h", "cast(k * 90 AS double) AS deg", "res", "res * 2 + cast(k AS double) AS b", "0.2D + k * 0.1D AS d")
    out = windows.demag_amplitudes(rows)
    return out.select("act", "t", "h", *(F.round(c, n).alias(c) for c, n in (("delta_res", 6), ("mean_res", 6), ("amp_res", 6), ("a_dem_pct", 5), ("delta_b", 6), ("d_ratio", 6))))


@query(f"WITH {RUNS} SELECT event_id, round(v / nullif(max(v) OVER (PARTITION BY run), 0), 8) AS amp_ratio FROM runs")
def ratio_to_max(spark, d):
    return windows.ratio_to_max(table(spark, d, "runs"), ["run"], "v").select("event_id", F.round("amp_ratio", 8).alias("amp_ratio"))


@query(f"WITH {RUNS} SELECT run, event_id, v, cast(row_number() OVER (PARTITION BY run ORDER BY v DESC, event_id) AS int) AS rank FROM runs QUALIFY rank <= 3")
def top_n(spark, d):
    return windows.top_n(table(spark, d, "runs"), ["run"], "v", 3, "event_id").select("run", "event_id", "v", "rank")


@query(f"WITH {RUNS}, r AS (SELECT run, v, row_number() OVER (PARTITION BY run ORDER BY event_id) AS k FROM runs) SELECT run, round(max(CASE WHEN k = 2 THEN v END) / nullif(max(CASE WHEN k = 1 THEN v END), 0), 8) AS ratio FROM r GROUP BY run")
def first_second_ratio(spark, d):
    return windows.first_second_ratio(table(spark, d, "runs"), ["run"], "event_id", "v").withColumn("ratio", F.round("ratio", 8))


@query("""WITH w AS (SELECT event_type, event_id, value, cast(row_number() OVER k AS int) AS row, avg(value) OVER f AS center, 3 * stddev_samp(value) OVER f / sqrt(5.0) AS half FROM events
        WINDOW k AS (PARTITION BY event_type ORDER BY ts, event_id), f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_type, event_id, row, round(center, 6) AS center, round(center + half, 6) AS upper, round(center - half, 6) AS lower, value > center + half OR value < center - half AS alert FROM w WHERE row >= 5""")
def control_limits(spark, d):
    out = windows.control_limits(table(spark, d, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], ["ts", "event_id"], "value")
    return out.select("event_type", "event_id", F.col("row").cast("int").alias("row"), *(F.round(c, 6).alias(c) for c in ("center", "upper", "lower")), "alert")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM orders)
    SELECT category, count(*) AS n FROM (SELECT cast(1 + len(list_filter(cuts, lambda c: c < o_totalprice)) AS int) AS category FROM orders, q) GROUP BY category""")
def score_category(spark, d):
    return windows.score_category(table(spark, d, "orders"), "o_totalprice").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    """A top-k report."""
    return windows.top_k(table(spark, d, "orders"), "o_totalprice", 10, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey AS id, s_acctbal AS balance, 0.0::double AS extra FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_nationkey::double FROM customer")
def union_fill(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance")
    b = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "cast(c_nationkey AS double) AS extra")
    return windows.union_fill(a, b)

