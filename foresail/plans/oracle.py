"""Independent SQL for the named queries, written for DuckDB on the same tables.

Common table expressions are kept by name with what they read; ``_sql`` prefixes a final
SELECT with just those it needs. The formulations (self-joins, GROUP BY, plain row_number and
median) deliberately differ from the Spark side."""

from __future__ import annotations

# --- fixed values, stated again here so that a wrong one on the Spark side shows ---------------
METHOD_WEIGHTS = {"seasonal": 0.4, "scored": 0.3, "rules": 0.3}
# name, min %, max %, default %
SCENARIO_LEVERS = (
    ("Growth Rate", -20, 50, 0),
    ("Market Growth", -10, 30, 0),
    ("Marketing Spend", -5, 25, 0),
    ("Seasonality", -15, 15, 0),
    ("Customer Retention", -10, 20, 0),
)
SEED42_NORMALS = (
    0.4967141530112327, -0.13826430117118466, 0.6476885381006925, 1.5230298564080254,
    -0.23415337472333597, -0.23413695694918055, 1.5792128155073915, 0.7674347291529088,
    -0.4694743859349521, 0.5425600435859647, -0.46341769281246226, -0.46572975357025687,
)
STAGE_COLOR = {"inquiry": "#0ea5e9", "quote_sent": "#3b82f6", "booked": "#8b5cf6", "final_payment": "#10b981", "completed": "#059669"}
# section, item name, plural, minimum items, (field, minimum length, ending)
SECTIONS = (
    ("positive_factors", "Positive factor", "positive factors", 3,
     (("factor", 10, " description"), ("impact", 10, " description"), ("evidence", 10, " description"))),
    ("negative_factors", "Negative factor", "negative factors", 2,
     (("factor", 10, " description"), ("impact", 10, " description"), ("evidence", 10, " description"))),
    ("immediate_actions", "Immediate action", "immediate actions", 3,
     (("action", 20, " description (too short or empty)"), ("rationale", 20, ""), ("expected_impact", 10, ""))),
    ("strategic_initiatives", "Strategic initiative", "strategic initiatives", 2,
     (("initiative", 20, " description (too short or empty)"), ("rationale", 20, ""), ("expected_impact", 10, ""))),
    ("risk_mitigation", "Risk mitigation", "risk mitigations", 2,
     (("risk", 20, " description (too short or empty)"), ("mitigation", 20, " description (too short or empty)"))),
    ("optimization_opportunities", "Optimization opportunity", "optimization opportunities", 2,
     (("opportunity", 20, " description (too short or empty)"), ("description", 20, ""))),
    ("key_insights", "Key insight", "key insights", 3, ()),
)
# ------------------------------------------------------------------------------------------------

AS_OF = "DATE '2001-08-01'"
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: str, body: str) -> None:
    _CTES[name] = (tuple(needs.split()), body)


def _sql(needs: str, final: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + final


def _r(cols: str, places: int = 4) -> str:
    """Rounded columns; ``expr AS name`` items are kept as they are."""
    return ", ".join(f"round({c.strip()}, {places}) AS {c.strip()}" for c in cols.split(","))


_cte("o", "", """
  SELECT o_orderkey k, o_custkey, o_orderstatus st, CAST(o_orderdate AS DATE) inquiry_date, o_totalprice,
         (o_orderkey*7919+13)%100 h,
         CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey)>1 THEN 1 ELSE 0 END rep
  FROM orders""")
_cte("s0", "o", """
  SELECT o.*, r_name destination, c_mktsegment lead_source,
   CASE WHEN inquiry_date >= DATE '2001-02-02' AND st<>'F' THEN
      CASE WHEN h<50 THEN 'inquiry' WHEN h<80 THEN 'quote_sent' WHEN h<95 THEN 'booked' ELSE 'final_payment' END
   ELSE CASE WHEN h<35+15*rep THEN 'completed' WHEN h<38+15*rep THEN 'cancelled' ELSE 'lost' END END stage
  FROM o JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")
_cte("d0", "s0", """
  SELECT *, CASE WHEN stage IN ('quote_sent','booked','final_payment','completed','cancelled') OR (stage='lost' AND h%2=0)
        THEN inquiry_date + CAST(1+k%7 AS INT) END quote_date FROM s0""")
_cte("b0", "d0", """
  SELECT *, CASE WHEN stage IN ('booked','final_payment','completed','cancelled') THEN quote_date + CAST(5+k%26 AS INT) END booking_date FROM d0""")
_cte("t0", "b0", """
  SELECT *, CASE WHEN booking_date IS NOT NULL THEN booking_date + CAST(30+k%151 AS INT) END trip_date FROM b0""")
_cte("leads", "t0", """
  SELECT concat('LEAD_', CAST(k AS VARCHAR(20))) lead_id, inquiry_date, destination,
  CASE WHEN stage IN ('lost','cancelled') THEN 0.0::DOUBLE ELSE o_totalprice END trip_price, lead_source,
  stage current_stage, rep is_repeat_customer, quote_date, booking_date, trip_date,
  CASE WHEN stage IN ('final_payment','completed','cancelled') THEN trip_date - CAST(7+k%24 AS INT) END final_payment_date,
  CASE k%4 WHEN 0 THEN 7 WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 21 END duration_days
  FROM t0""")
_cte("done", "leads", f"""
  SELECT * FROM leads WHERE current_stage='completed' AND trip_date IS NOT NULL AND trip_date <= {AS_OF}""")
_cte("open_leads", "leads", f"""
  SELECT * REPLACE (CASE WHEN current_stage='completed' THEN 'final_payment' ELSE current_stage END AS current_stage)
  FROM leads WHERE (inquiry_date <= {AS_OF} AND current_stage IN ('inquiry','quote_sent','booked','final_payment'))
     OR (current_stage='completed' AND trip_date > {AS_OF})""")
_cte("monthly", "done", """
  SELECT 'ALL' series_id, CAST(date_trunc('month', trip_date) AS DATE) AS month,
         CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE) revenue, count(lead_id) trip_count FROM done GROUP BY 2
  UNION ALL
  SELECT destination, CAST(date_trunc('month', trip_date) AS DATE),
         CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE), count(lead_id) FROM done GROUP BY 1, 2""")
_cte("supplier_monthly", "", f"""
  SELECT CASE WHEN g=1 THEN 'ALL' ELSE CAST(l_suppkey AS VARCHAR) END series_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) revenue, count(*) trip_count
  FROM lineitem, (VALUES (0),(1)) t(g) GROUP BY 1, 2""")
_cte("supplier_monthly_asof", "", f"""
  SELECT CASE WHEN g=1 THEN 'ALL' ELSE CAST(l_suppkey AS VARCHAR) END series_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) revenue, count(*) trip_count
  FROM lineitem, (VALUES (0),(1)) t(g) WHERE CAST(l_shipdate AS DATE) <= {AS_OF} GROUP BY 1, 2""")


def _series_chain(src: str, p: str) -> None:
    """Calendar filling and trimming over ``src``; names are prefixed with ``p``."""
    _cte(f"{p}filled", src, f"""
  SELECT c.series_id, c.month, coalesce(m.revenue, 0.0) revenue, coalesce(m.trip_count, 0) trip_count
  FROM (SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
        FROM {src} GROUP BY series_id) c
  LEFT JOIN {src} m ON m.series_id=c.series_id AND m.month=c.month""")
    _cte(f"{p}tail_mean", f"{p}filled", f"""
  SELECT series_id, avg(trip_count) mean_trips, avg(revenue) mean_revenue
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) r FROM {p}filled WHERE trip_count > 0)
  WHERE r <= 6 GROUP BY series_id""")
    _cte(f"{p}flagged", f"{p}filled {p}tail_mean", f"""
  SELECT f.series_id, f.month, f.revenue, f.trip_count, f.rn_desc,
         (n > 2 AND mean_trips IS NOT NULL AND rn_desc <= 4 AND
          (trip_count < 0.5*mean_trips OR revenue < 0.3*mean_revenue OR revenue < 1000)) incomplete
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) rn_desc,
               count(*) OVER (PARTITION BY series_id) n FROM {p}filled) f
  LEFT JOIN {p}tail_mean USING (series_id)""")
    _cte(f"{p}tailcut", f"{p}flagged", f"""
  SELECT f.series_id, f.month, f.revenue, f.trip_count FROM {p}flagged f
  WHERE EXISTS (SELECT 1 FROM {p}flagged g WHERE g.series_id=f.series_id AND g.month >= f.month AND NOT g.incomplete)""")
    _cte(f"{p}hist", f"{p}tailcut", f"""
  SELECT series_id, month, revenue, trip_count FROM (
    SELECT *, lag(revenue) OVER (PARTITION BY series_id ORDER BY month) prev,
           row_number() OVER (PARTITION BY series_id ORDER BY month DESC) e FROM {p}tailcut)
  WHERE NOT coalesce(e=1 AND revenue>0 AND prev>0 AND revenue/prev < 0.2, false)""")


_series_chain("monthly", "")
_series_chain("supplier_monthly_asof", "sup_")


def _drop_anomalous(src: str, name: str) -> None:
    _cte(name, src, f"""
  SELECT series_id, month, revenue, trip_count FROM (
    SELECT *, avg(revenue) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) a,
           row_number() OVER (PARTITION BY series_id ORDER BY month DESC) e FROM {src})
  WHERE NOT coalesce(e=1 AND a IS NOT NULL AND ((a>0 AND revenue < 0.3*a) OR revenue < 1000), false)""")


_drop_anomalous("hist", "post")
_drop_anomalous("filled", "filled_post")

_cte("profile", "post", """
  SELECT series_id, "months", last_month, last_revenue, hist_mean, hist_std, hist_max, plain_mean_6, plain_mean_12,
         CASE WHEN coalesce(last_revenue < 0.3*rest6, false) THEN rest6 ELSE plain_mean_6 END recent_mean_6,
         CASE WHEN coalesce(last_revenue < 0.3*rest12, false) THEN rest12 ELSE plain_mean_12 END recent_mean_12,
         CASE WHEN coalesce(last_revenue < 0.3*rest12, false) THEN rest_std ELSE std12 END recent_std_12
  FROM (SELECT series_id, count(*) AS months, max(month) last_month, max(revenue) FILTER (e=1) last_revenue,
     avg(revenue) hist_mean, stddev_samp(revenue) hist_std, max(revenue) hist_max,
     avg(revenue) FILTER (e<=6) plain_mean_6, avg(revenue) FILTER (e<=12) plain_mean_12,
     avg(revenue) FILTER (e<=6 AND e>1) rest6, avg(revenue) FILTER (e<=12 AND e>1) rest12,
     stddev_samp(revenue) FILTER (e<=12) std12, stddev_samp(revenue) FILTER (e<=12 AND e>1) rest_std
     FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) e FROM post) GROUP BY series_id)""")


def _trend_chain(src: str, p: str, key: str = "series_id", linear: bool = False, months: int = 12, changes: bool = False) -> None:
    """Growth mode, fit and raw prediction over ``src`` grouped by ``key``."""
    on = " AND ".join(f"a.{k}=b.{k}" for k in key.split(", "))
    _cte(f"{p}num", src, f"""
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY month) - 1 t, count(*) OVER (PARTITION BY {key}) n,
         row_number() OVER (PARTITION BY {key} ORDER BY month DESC) e FROM {src}""")
    _cte(f"{p}growth", f"{p}num", f"""
  SELECT *, {'false' if linear else '''n >= 3 AND cap > 0 AND
    (((lastv-rfirst)/m <= 0 AND (lastv-firstv)/n > 0) OR (lastv-rfirst)/m < 0.5*(lastv-firstv)/n)'''} AS logistic
  FROM (SELECT {key}, max(n) n, max(month) last_month, least(6, max(n)) m, max(revenue) FILTER (e=1) lastv,
      max(revenue) FILTER (t=0) firstv, max(revenue) FILTER (e=least(6,n)) rfirst,
      greatest(1.5*max(revenue) FILTER (e<=6), 1.2*max(revenue)) cap FROM {p}num GROUP BY {key})""")
    _cte(f"{p}y", f"{p}num {p}growth", f"""
  SELECT a.*, b.logistic, b.cap, CASE WHEN b.logistic THEN
     ln(least(greatest(a.revenue, 0.001*b.cap), 0.999*b.cap) / (b.cap - least(greatest(a.revenue, 0.001*b.cap), 0.999*b.cap)))
     ELSE a.revenue END y FROM {p}num a JOIN {p}growth b ON {on}""")
    _cte(f"{p}straight", f"{p}y", f"""
  SELECT {key}, coalesce(regr_slope(y, t), 0) slope, coalesce(regr_intercept(y, t), avg(y)) intercept FROM {p}y GROUP BY {key}""")
    if changes:  # one bend, where the error falls by more than its cost: normal equations by place
        _cte(f"{p}sums", f"{p}y", f"""
  SELECT {key}, kink, max(n)::DOUBLE m, sum(t::DOUBLE) st, sum(y) sy, sum(h) sh, sum(t::DOUBLE*t) stt, sum(t*y) sty, sum(y*y) syy, sum(h*h) shh, sum(t*h) sth, sum(h*y) shy
  FROM (SELECT {key}, n, t, y, kink, greatest(t - kink, 0)::DOUBLE h FROM (
    SELECT *, unnest(list_distinct(list_transform(range(1, 25), lambda k: 4*n*k // 125))) kink FROM {p}y WHERE n >= 12) WHERE kink BETWEEN 1 AND n - 3) GROUP BY {key}, kink""")
        _cte(f"{p}bent", f"{p}sums", f"""
  SELECT {key}, kink, bend, slope, (sy - slope*st - bend*sh)/m intercept, m, greatest(yy - ty*ty/tt, yy*1e-9) err0, greatest(yy - slope*ty - bend*hy, yy*1e-9) err1
  FROM (SELECT *, (tt*hy - th*ty)/(tt*hh - th*th) bend, (hh*ty - th*hy)/(tt*hh - th*th) slope FROM (
    SELECT *, stt - st*st/m tt, sty - st*sy/m ty, syy - sy*sy/m yy, shh - sh*sh/m hh, sth - st*sh/m th, shy - sh*sy/m hy FROM {p}sums))""")
        _cte(f"{p}line", f"{p}straight {p}bent", f"""
  SELECT {key}, coalesce(b.slope, s.slope) slope, coalesce(b.intercept, s.intercept) intercept, coalesce(b.bend, 0) bend, coalesce(b.kink, 0) kink
  FROM {p}straight s LEFT JOIN (SELECT * FROM {p}bent WHERE err1 > 0 AND m*ln(err0/err1) > 3*ln(m)
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY err1, kink) = 1) b USING ({key})""")
    else:
        _cte(f"{p}line", f"{p}straight", f"SELECT *, 0 bend, 0 kink FROM {p}straight")
    _cte(f"{p}resid", f"{p}y {p}line", f"""
  SELECT a.*, extract(month FROM a.month) moy, a.revenue - CASE WHEN a.logistic
     THEN a.cap/(1+exp(-(b.intercept+b.slope*a.t+b.bend*greatest(a.t-b.kink, 0)))) ELSE b.intercept+b.slope*a.t+b.bend*greatest(a.t-b.kink, 0) END r
  FROM {p}y a JOIN {p}line b ON {on}""")
    _cte(f"{p}effect", f"{p}resid", f"SELECT {key}, moy, avg(r) effect FROM {p}resid GROUP BY {key}, moy")
    _cte(f"{p}season", f"{p}effect", f"""
  SELECT {key}, moy, effect - avg(effect) OVER (PARTITION BY {key}) seasonal FROM {p}effect""")
    _cte(f"{p}sigma", f"{p}resid {p}season", f"""
  SELECT {', '.join('a.' + k for k in key.split(', '))}, coalesce(stddev_samp(a.r - b.seasonal), 0) sigma
  FROM {p}resid a JOIN {p}season b ON {on} AND a.moy=b.moy GROUP BY {', '.join('a.' + k for k in key.split(', '))}""")
    using = f"USING ({key})"
    _cte(f"{p}raw", f"{p}growth {p}line {p}sigma {p}season", f"""
  SELECT {key}, month, h, f forecast, f-1.2816*sigma lower, f+1.2816*sigma upper FROM (
   SELECT {key}, h, sigma, CAST(last_month + to_months(CAST(h AS INT)) AS DATE) AS month,
     CASE WHEN logistic THEN cap/(1+exp(-line)) ELSE line END + coalesce(seasonal, 0) f
   FROM (SELECT *, extract(month FROM last_month + to_months(CAST(h AS INT))) moy, intercept+slope*(n-1+h)+bend*greatest(n-1+h-kink, 0) line
         FROM {p}growth JOIN {p}line {using} JOIN {p}sigma {using}, range(1, {months + 1}) hh(h))
   LEFT JOIN {p}season USING ({key}, moy))""")
    if key == "series_id":
        _cte(f"{p}fc", f"{p}raw", f"""
  SELECT series_id, month, CASE WHEN med > 0 THEN least(f, 3*med) ELSE f END forecast, lower, upper FROM (
   SELECT series_id, month, greatest(forecast, 0) f, greatest(lower, 0) lower, greatest(upper, 0) upper,
     median(greatest(forecast, 0)) OVER (PARTITION BY series_id) med FROM {p}raw)""")


_trend_chain("post", "tp_")
_trend_chain("post", "tl_", linear=True)
_trend_chain("hist", "th_")
_trend_chain("hist", "thl_", linear=True)
_trend_chain("sup_hist", "ts_")
_trend_chain("hist", "thc_", changes=True)
_trend_chain("sup_hist", "tsc_", changes=True)

_cte("bt_hist", "hist", """
  SELECT a.series_id, b.month cutoff, a.month, a.revenue FROM hist a
  JOIN hist b ON a.series_id=b.series_id AND a.month <= b.month
  JOIN (SELECT series_id, min(month) lo, max(month) hi FROM hist GROUP BY 1) c ON a.series_id=c.series_id
  WHERE b.month >= lo + INTERVAL 6 MONTH AND b.month <= hi - INTERVAL 3 MONTH""")
_trend_chain("bt_hist", "bt_", "series_id, cutoff", months=3)
_cte("backtest", "bt_raw hist", """
  SELECT r.series_id, r.cutoff, CAST(h AS BIGINT) h, r.month, greatest(forecast, 0) forecast, revenue actual
  FROM bt_raw r JOIN hist ON r.series_id=hist.series_id AND r.month=hist.month""")

# --- rates and open value ------------------------------------------------------------------
_cte("stages", "", """
  SELECT * FROM (VALUES (1,'inquiry'),(2,'quote_sent'),(3,'booked'),(4,'final_payment'),(5,'completed')) v(no, stage)""")
_cte("reached", "leads stages", """
  SELECT v.stage, lead_source, is_repeat_customer,
    (current_stage='completed' AND CASE v.stage WHEN 'inquiry' THEN true WHEN 'quote_sent' THEN quote_date IS NOT NULL
       WHEN 'booked' THEN booking_date IS NOT NULL ELSE final_payment_date IS NOT NULL END) fin,
    (v.no=1 OR coalesce(c.no >= v.no, false)) hit
  FROM leads LEFT JOIN stages c ON c.stage=current_stage, (SELECT * FROM stages WHERE no<=4) v""")
_cte("flat", "reached", """
  SELECT stage, count(*) FILTER (fin) completed, count(*) FILTER (hit) total,
    CASE WHEN count(*) FILTER (hit)>0 THEN count(*) FILTER (fin)/count(*) FILTER (hit) ELSE 0 END rate FROM reached GROUP BY stage""")
_cte("seg", "reached", """
  SELECT stage, lead_source, is_repeat_customer, count(*) FILTER (fin) completed, count(*) FILTER (hit) total,
    CASE WHEN count(*) FILTER (hit) >= 20 THEN count(*) FILTER (fin)/count(*) FILTER (hit) END rate
  FROM reached GROUP BY ALL HAVING count(*) FILTER (hit) > 0""")
_cte("looked", "open_leads seg flat", """
  SELECT o.*, coalesce(seg.rate, flat.rate, 0) conversion_rate,
    CASE WHEN seg.rate IS NOT NULL THEN 'segmented' WHEN flat.rate IS NOT NULL THEN 'flat' ELSE 'missing' END tier
  FROM open_leads o LEFT JOIN seg ON seg.stage=o.current_stage AND seg.lead_source=o.lead_source
       AND seg.is_repeat_customer=o.is_repeat_customer
  LEFT JOIN flat ON flat.stage=o.current_stage""")
_cte("rule_totals", "looked", """
  SELECT 'ALL' series_id, count(*) leads, CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE) open_value,
         sum(trip_price*conversion_rate) total FROM looked
  UNION ALL SELECT destination, count(*), CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE),
         sum(trip_price*conversion_rate) FROM looked GROUP BY 1""")
_cte("rules", "rule_totals profile", f"""
  SELECT series_id, CAST(start + to_months(CAST(i AS INT)) AS DATE) AS month, v forecast, 0.8*v lower, 1.2*v upper, 'rules' AS method
  FROM (SELECT series_id, coalesce(last_month + INTERVAL 1 MONTH, date_trunc('month', {AS_OF})) start,
     CASE WHEN coalesce(total,0)=0 AND last_month IS NOT NULL THEN plain_mean_12 ELSE greatest(coalesce(total,0),0)/12 END v
     FROM profile FULL JOIN rule_totals USING (series_id)), range(0, 12) r(i)""")
_cte("full_value", "rule_totals profile", f"""
  SELECT series_id, CAST(start + to_months(CAST(i AS INT)) AS DATE) AS month, v forecast, 0.8*v lower, 1.2*v upper, 'full_value' AS method
  FROM (SELECT series_id, coalesce(last_month + INTERVAL 1 MONTH, date_trunc('month', {AS_OF})) start,
     CASE WHEN coalesce(open_value,0)=0 AND last_month IS NOT NULL THEN plain_mean_12 ELSE coalesce(open_value,0)/12 END v
     FROM profile FULL JOIN rule_totals USING (series_id)), range(0, 12) r(i)""")
_cte("score_totals", "open_leads", """
  SELECT series_id, count(*) leads, CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE) open_value, avg(score) mean_probability, sum(trip_price*score) total
  FROM (SELECT unnest(['ALL', destination]) series_id, trip_price,
     (duration_days + 3*extract(month FROM inquiry_date) + 20*is_repeat_customer)/100.0::DOUBLE score FROM open_leads) GROUP BY 1""")
_cte("scored", "score_totals profile", f"""
  SELECT series_id, CAST(start + to_months(CAST(i AS INT)) AS DATE) AS month, v forecast, 0.7*v lower, 1.3*v upper, 'scored' AS method
  FROM (SELECT series_id, coalesce(last_month + INTERVAL 1 MONTH, date_trunc('month', {AS_OF})) start, total/12 v
     FROM score_totals LEFT JOIN profile USING (series_id) WHERE total > 0), range(0, 12) r(i)""")

# --- ensemble --------------------------------------------------------------------------------
_cte("z", "", "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {v!r})" for i, v in enumerate(SEED42_NORMALS)) + ") zz(i, z)")
_cte("seas1", "tp_fc profile", """
  SELECT f.*, p.* EXCLUDE (series_id), row_number() OVER (PARTITION BY f.series_id ORDER BY month) i,
    first_value(forecast) OVER (PARTITION BY f.series_id ORDER BY month) f0 FROM tp_fc f JOIN profile p ON f.series_id=p.series_id""")
_cte("damped", "seas1", """
  SELECT * REPLACE (CASE WHEN f0 > 1.3*plain_mean_6 THEN forecast*(0.7+0.3*(i-1)/12) + plain_mean_6*(1-(0.7+0.3*(i-1)/12)) ELSE forecast END AS forecast),
    f0 > 1.3*plain_mean_6 hi FROM seas1""")
_cte("damped2", "damped", """
  SELECT * REPLACE (CASE WHEN hi THEN greatest(0.75*forecast,0) ELSE lower END AS lower,
                    CASE WHEN hi THEN greatest(1.25*forecast,0) ELSE upper END AS upper) FROM damped""")


def _cap(src: str, name: str, mean: str) -> None:
    _cte(name, src, f"""
  SELECT * EXCLUDE (over_, cl) REPLACE (CASE WHEN over_ THEN least(forecast, cl) ELSE forecast END AS forecast,
       CASE WHEN over_ THEN least(upper, 1.5*cl) ELSE upper END AS upper) FROM (
    SELECT *, greatest(1.5*hist_max, 2*{mean}) cl,
      coalesce(max(forecast) OVER (PARTITION BY series_id) > greatest(1.5*hist_max, 2*{mean}), false) over_ FROM {src})""")


_cap("damped2", "capped1", "plain_mean_6")
_cap("seas1", "capped_e14", "recent_mean_6")
_CV = "coalesce(CASE WHEN recent_mean_6 > 0 THEN recent_std_12/recent_mean_6 ELSE 0.3 END, 0.3)"
_HCV = "coalesce(CASE WHEN hist_mean > 0 THEN hist_std/hist_mean ELSE 0.3 END, 0.3)"
_cte("seasonal", "capped1 z", f"""
  SELECT series_id, month, f forecast, greatest(0.75*f,0) lower, greatest(1.25*f,0) upper, 'seasonal' AS method FROM (
   SELECT c.series_id, c.month, forecast*least(greatest(1+0.5*{_HCV}*z, 0.7), 1.3) f FROM capped1 c JOIN z USING (i))""")


def _ensemble(name: str, parts: str) -> None:
    union = " UNION ALL BY NAME ".join(f"SELECT series_id, month, forecast, lower, upper, method FROM {p}" for p in parts.split())
    weights = " ".join(f"WHEN '{m}' THEN {w}" for m, w in METHOD_WEIGHTS.items())
    _cte(f"{name}_u", parts, f"""
  SELECT u.*, CASE method {weights} ELSE 1.0/k END w FROM ({union}) u
  JOIN (SELECT series_id, count(DISTINCT method) k FROM ({union}) GROUP BY 1) kk USING (series_id)""")
    _cte(name, f"{name}_u", f"""
  SELECT series_id, month, sum(w*forecast)/any_value(d) forecast, sum(w*lower)/any_value(d) lower, sum(w*upper)/any_value(d) upper
  FROM {name}_u JOIN (SELECT series_id, CASE WHEN abs(sum(w)-1) > 0.01 THEN sum(w) ELSE 1 END d
     FROM (SELECT DISTINCT series_id, method, w FROM {name}_u) GROUP BY 1) USING (series_id) GROUP BY 1, 2""")


def _finish(ens: str, p: str) -> None:
    _cte(f"{p}1", f"{ens} profile", f"""
  SELECT f.series_id, month, greatest(forecast,0) forecast, greatest(lower,0) lower, greatest(upper,0) upper,
    q.* EXCLUDE (series_id), row_number() OVER (PARTITION BY f.series_id ORDER BY month) i FROM {ens} f LEFT JOIN profile q ON f.series_id=q.series_id""")
    _cap(f"{p}1", f"{p}2", "recent_mean_6")
    _cte(f"{p}3", f"{p}2 z", f"""
  SELECT a.series_id, a.month, a.i, a.last_revenue, {_CV.replace('recent', 'a.recent')} cv,
    greatest((SELECT sum(b.forecast * CASE WHEN b.i=1 THEN power(0.3, a.i-1) ELSE 0.7*power(0.3, a.i-b.i) END)
       FROM {p}2 b WHERE b.series_id=a.series_id AND b.i<=a.i)
     * (1+least(greatest(0.4*{_CV.replace('recent', 'a.recent')}*z, -0.25), 0.25)), 0) v FROM {p}2 a JOIN z ON z.i=a.i""")
    _cte(f"{p}fc", f"{p}3", f"""
  SELECT series_id, month, g forecast, CASE WHEN jump THEN greatest(0.7*g,0) ELSE greatest(g*(1-cv),0) END lower,
    CASE WHEN jump THEN greatest(1.3*g,0) ELSE g*(1+cv) END upper FROM (
   SELECT *, CASE WHEN jump AND i<=3 THEN last_revenue*(1-0.2*i) + v*0.2*i ELSE v END g FROM (
    SELECT *, CASE WHEN last_revenue>0 THEN first_value(v) OVER (PARTITION BY series_id ORDER BY month)/last_revenue > 1.3 ELSE true END jump FROM {p}3))""")


_ensemble("ens", "seasonal rules")
_ensemble("ens3", "seasonal rules scored")
_ensemble("ensx", "seasonal rules full_value")
_finish("ens", "fin_")
_finish("ens3", "fin3_")
_cte("fc", "fin_fc", "SELECT * FROM fin_fc")
_cte("bookings", "hist leads", """
  SELECT h.series_id, h.month, any_value(revenue) revenue, any_value(trip_count) trip_count, nullif(count(d.lead_id), 0) bookings
  FROM hist h LEFT JOIN leads d ON (h.series_id='ALL' OR h.series_id=d.destination) AND d.current_stage='completed'
    AND d.trip_date >= h.month AND d.trip_date < h.month + INTERVAL 1 MONTH GROUP BY 1, 2""")
_cte("points", "bookings fc", """
  SELECT series_id, month, revenue, bookings, 'historical' AS type, NULL::DOUBLE lower, NULL::DOUBLE upper FROM bookings
  UNION ALL SELECT series_id, month, forecast, NULL, 'forecast', lower, upper FROM fc""")
_cte("fcn", "fc", """
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) i, lag(forecast) OVER (PARTITION BY series_id ORDER BY month) prev FROM fc""")
_cte("cohort", "leads", "SELECT * FROM leads WHERE inquiry_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'")
_cte("funnel", "cohort stages", """
  SELECT destination, CAST(no AS INT) stage_no, stage,
    count(*) FILTER (CASE no WHEN 1 THEN inquiry_date WHEN 2 THEN quote_date WHEN 3 THEN booking_date WHEN 4 THEN final_payment_date ELSE trip_date END IS NOT NULL) AS count,
    CAST(coalesce(sum(CAST(trip_price AS DECIMAL(18,2))) FILTER (CASE no WHEN 1 THEN inquiry_date WHEN 2 THEN quote_date WHEN 3 THEN booking_date WHEN 4 THEN final_payment_date ELSE trip_date END IS NOT NULL), 0) AS DOUBLE) revenue_potential
  FROM cohort, stages GROUP BY 1, 2, 3""")
_cte("current", "leads stages", f"""
  SELECT d.destination, CAST(no AS INT) stage_no, stage, count(lead_id) AS count,
    CAST(coalesce(sum(CAST(trip_price AS DECIMAL(18,2))), 0) AS DOUBLE) revenue_potential
  FROM (SELECT DISTINCT destination FROM leads WHERE inquiry_date <= {AS_OF} AND current_stage IN ('inquiry','quote_sent','booked','final_payment')) d
  CROSS JOIN (SELECT * FROM stages WHERE no <= 4) v
  LEFT JOIN leads l ON l.destination=d.destination AND l.current_stage=v.stage AND inquiry_date <= {AS_OF} GROUP BY 1, 2, 3""")
_cte("current_all", "current", """
  SELECT stage_no, stage, CAST(sum(count) AS BIGINT) AS count, sum(revenue_potential) revenue_potential FROM current GROUP BY 1, 2""")
_cte("keyed", "leads", "SELECT unnest(['ALL', destination]) series_id, leads.* FROM leads")
_cte("stat", "keyed", f"""
  SELECT series_id, count(*) total, count(*) FILTER (current_stage='completed') completed,
    round_even(100.0::DOUBLE*count(*) FILTER (current_stage='completed')/count(*), 2) rate,
    CAST(coalesce(sum(CAST(trip_price AS DECIMAL(18,2))) FILTER (current_stage='completed'), 0) AS DOUBLE) revenue,
    coalesce(CAST(sum(CAST(trip_price AS DECIMAL(18,2))) FILTER (current_stage='completed') AS DOUBLE)/count(trip_price) FILTER (current_stage='completed'), 0) average_price,
    count(*) FILTER ((inquiry_date <= {AS_OF} AND current_stage IN ('inquiry','quote_sent','booked','final_payment')) OR (current_stage='completed' AND trip_date > {AS_OF})) open_leads,
    CAST(coalesce(sum(CAST(trip_price AS DECIMAL(18,2))) FILTER ((inquiry_date <= {AS_OF} AND current_stage IN ('inquiry','quote_sent','booked','final_payment')) OR (current_stage='completed' AND trip_date > {AS_OF})), 0) AS DOUBLE) open_value
  FROM keyed GROUP BY 1""")


def _top(col: str) -> str:
    return f"""SELECT series_id, {col} top, n FROM (SELECT series_id, {col}, count(*) n,
      row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, {col}) r FROM keyed WHERE {col} IS NOT NULL GROUP BY 1, 2) WHERE r=1"""


_USD = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"
_PCT = "printf('%.1f', round_even({0}, 1))"
_cte("mstat", "hist", "SELECT series_id, avg(revenue) average_monthly, count(*) total_months FROM hist GROUP BY 1")
_cte("said", "stat mstat", f"""
  SELECT series_id, list_filter([
   CASE WHEN rate > 30 THEN 'Strong conversion rate of ' || {_PCT.format('rate')} || '% indicates effective sales processes.'
        WHEN rate > 20 THEN 'Conversion rate of ' || {_PCT.format('rate')} || '% shows solid sales performance with room for improvement.'
        WHEN rate > 0 THEN 'Conversion rate of ' || {_PCT.format('rate')} || '% suggests opportunities to optimize sales processes.' END,
   CASE WHEN average_price > 0 THEN 'Average trip value of $' || {_USD.format('average_price')} || ' provides solid revenue foundation.' END,
   CASE WHEN revenue > 0 THEN 'Total historical revenue of $' || {_USD.format('revenue')} || ' demonstrates strong business performance.' END,
   CASE WHEN average_monthly > 0 THEN 'Average monthly revenue of $' || {_USD.format('average_monthly')} || ' indicates stable revenue streams.' END,
   CASE WHEN total_months >= 12 THEN 'Historical data spans ' || total_months || ' months, providing robust foundation for forecasting.' END
  ], lambda x: x IS NOT NULL) l FROM stat LEFT JOIN mstat USING (series_id)""")
_cte("drivers", "stat keyed", f"""
  SELECT series_id, list_filter([
   s.top || ' is the primary lead source (' || s.n || ' leads)',
   d.top || ' is the most popular destination (' || d.n || ' trips)',
   CASE WHEN rate > 0 THEN 'Conversion rate of ' || {_PCT.format('rate')} || '% indicates strong sales performance' END,
   CASE WHEN average_price > 0 THEN 'Average trip value of $' || {_USD.format('average_price')} || ' supports premium positioning' END,
   CASE WHEN open_leads > 0 THEN 'Active pipeline of ' || open_leads || ' leads with $' || {_USD.format('open_value')} || ' potential revenue' END
  ], lambda x: x IS NOT NULL) l FROM stat LEFT JOIN ({_top('lead_source')}) s USING (series_id) LEFT JOIN ({_top('destination')}) d USING (series_id)""")
_cte("resolved", "leads", """
  SELECT *, CAST(current_stage='completed' AS INT) converted FROM leads WHERE current_stage IN ('completed','lost','cancelled')""")
_cte("split", "resolved", """
  SELECT *, row_number() OVER (PARTITION BY converted ORDER BY md5(lead_id)) <= ceil(0.2*count(*) OVER (PARTITION BY converted)) is_test FROM resolved""")
_cte("scores", "split", """
  SELECT *, (duration_days + 3*extract(month FROM inquiry_date) + 20*is_repeat_customer)/100.0::DOUBLE score FROM split""")
_cte("ranked", "scores", """
  SELECT *, rank() OVER (PARTITION BY is_test ORDER BY score) + (count(*) OVER (PARTITION BY is_test, score) - 1)/2.0 mid FROM scores""")
_cte("coded", "split", """
  SELECT lead_id, converted AS y, is_test, [dense_rank() OVER (ORDER BY coalesce(destination, 'Unknown')) - 1, dense_rank() OVER (ORDER BY coalesce(lead_source, 'Unknown')) - 1,
    coalesce(duration_days, 0), coalesce(is_repeat_customer, 0), extract(month FROM inquiry_date), extract(quarter FROM inquiry_date),
    CASE WHEN extract(month FROM inquiry_date) IN (1,2,3,9,10) THEN 1 ELSE 0 END]::DOUBLE[] AS x FROM split""")
_cte("level0", "coded", "SELECT lead_id, y, x, 1 AS node FROM coded WHERE NOT is_test")
for _k in range(4):  # gain of every cut of every feature, in second order around a probability of one half
    _cte(f"cuts{_k}", f"level{_k}", f"""
  SELECT *, gl*gl/(hl+1) + (g-gl)*(g-gl)/(h-hl+1) - g*g/(h+1) AS gain FROM (
    SELECT node, f, v, lead(v) OVER seen AS after, sum(g) OVER seen AS gl, sum(h) OVER seen AS hl, sum(g) OVER (PARTITION BY node, f) AS g, sum(h) OVER (PARTITION BY node, f) AS h
    FROM (SELECT node, f, x[f] AS v, sum(0.5::DOUBLE - y) AS g, sum(0.25::DOUBLE) AS h FROM (SELECT *, unnest(range(1, 8)) AS f FROM level{_k}) GROUP BY node, f, v)
    WINDOW seen AS (PARTITION BY node, f ORDER BY v)) WHERE after IS NOT NULL AND hl >= 1 AND h - hl >= 1""")
    _cte(f"best{_k}", f"cuts{_k}", f"""
  SELECT node, f, (v + after)/2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, v) AS place
    FROM (SELECT *, max(gain) OVER (PARTITION BY node) AS most FROM cuts{_k}) WHERE gain > 1e-6 AND gain >= most*(1 - 1e-9)) WHERE place = 1""")
    _cte(f"level{_k + 1}", f"level{_k} best{_k}", f"""
  SELECT lead_id, y, x, CASE WHEN b.f IS NULL THEN l.node WHEN x[b.f] <= cut THEN 2*l.node ELSE 2*l.node + 1 END AS node FROM level{_k} l LEFT JOIN best{_k} b ON b.node = l.node""")
_cte("periods", "leads", "SELECT strftime(inquiry_date, '%Y-%m') period, inquiry_date FROM leads")
_cte("known_periods", "periods", "SELECT period, row_number() OVER (ORDER BY period) - 1 code FROM (SELECT DISTINCT period FROM periods WHERE inquiry_date < DATE '2001-01-01')")
_cte("new_periods", "periods known_periods", "SELECT DISTINCT period FROM periods WHERE period NOT IN (SELECT period FROM known_periods)")


def _report_sql() -> str:
    """Sentences dealt to sections; one row per failing field or short section."""
    checks = []
    for i, (section, name, plural, least, fields) in enumerate(SECTIONS):
        checks.append(f"""SELECT report_id, '{section}' AS section, '-' AS field, 1 AS warnings,
          'Insufficient {plural}: ' || count(*) FILTER (sec={i}) || ' (minimum {least} required)' AS first_message
          FROM sent GROUP BY report_id HAVING count(*) FILTER (sec={i}) < {least}""")
        for (f, size, ending), part in zip(fields, ("s", "regexp_extract(s, '[^ ]*$')", "regexp_extract(s, '^[^ ]*')")):
            checks.append(f"""SELECT report_id, '{section}', '{f}', count(*),
              min('{name} ' || no || ' has incomplete ''{f}''{ending}') FROM sent
              WHERE sec={i} AND length({part}) < {size} GROUP BY report_id""")
    return """WITH raw AS (SELECT doc_id report_id, string_split(text, '. ') l FROM documents),
      sent AS (SELECT report_id, l[p] s, (p-1)%7 sec, (p-1)//7+1 no FROM (SELECT report_id, l, unnest(range(1, len(l)+1)) p FROM raw))
      """ + " UNION ALL ".join(checks)


def _scenario_values() -> str:
    rows = []
    for moved, low, high, usual in SCENARIO_LEVERS:
        for what, value in (("min", low), ("default", usual), ("max", high)):
            factor = " * ".join(f"(1 + {value if name == moved else default}/100.0::DOUBLE)" for name, _, _, default in SCENARIO_LEVERS)
            rows.append(f"('{moved}:{what}', {factor})")
    return "(VALUES " + ", ".join(rows) + ") sc(scenario, factor)"


def oracle_sql() -> dict[str, str]:
    color = "CASE stage " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in STAGE_COLOR.items()) + " ELSE '#6b7280' END"
    leads_cols = ("lead_id, inquiry_date, destination, trip_price, lead_source, current_stage, is_repeat_customer, "
                  "quote_date, booking_date, trip_date, final_payment_date, duration_days")
    series = "series_id, month, round(revenue, 4) AS revenue, trip_count"
    bands = "series_id, month, " + _r("forecast, lower, upper", 2)
    rates_cols = "stage, lead_source, is_repeat_customer, completed, total, round(rate, 6) AS rate"

    def funnel_rates(src: str, key: str) -> str:
        part = f"PARTITION BY {key} " if key else ""
        return f"""SELECT {key + ', ' if key else ''}stage_no, stage, count, round(revenue_potential, 4) AS revenue_potential,
          CASE WHEN p IS NOT NULL THEN CASE WHEN p>0 THEN round_even(count/p*100, 1) ELSE 0.0 END END AS conversion_rate,
          CASE WHEN p IS NOT NULL THEN CASE WHEN p>0 THEN round_even(100-count/p*100, 1) ELSE 100.0 END END AS drop_off_rate,
          CAST(NULL AS DOUBLE) AS avg_days_in_stage, {color} AS color
          FROM (SELECT *, lag(count) OVER ({part}ORDER BY stage_no) p FROM {src})"""

    def revenue_stats(key: str) -> str:
        k = f"{key}, " if key else ""
        return f"""SELECT {k}round(CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE), 4) AS total_revenue, count(*) AS trips,
          round(min(trip_price), 4) AS min_trip_value, round(max(trip_price), 4) AS max_trip_value, round(stddev_samp(trip_price), 4) AS std_trip_value,
          round(CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE)/count(*), 4) AS average_trip_value, round(median(trip_price), 4) AS median_trip_value
          FROM leads WHERE current_stage='completed' {'GROUP BY ' + key if key else ''}"""

    def monthly_stats(std: str) -> str:
        return f"""SELECT series_id, count(*) AS total_months, round(avg(revenue), 4) AS average_monthly, round(median(revenue), 4) AS median_monthly,
          round(min(revenue), 4) AS min_monthly, round(max(revenue), 4) AS max_monthly, round({std}(revenue), 4) AS std_monthly,
          min(month) AS first_month, max(month) AS last_month FROM hist GROUP BY 1"""

    date_case = ", ".join(f"CASE WHEN CAST(substr(lead_id, 6) AS BIGINT)%10 < 2 THEN NULL ELSE {c} END AS {c}"
                          for c in ("inquiry_date", "trip_date", "booking_date", "quote_date", "final_payment_date"))
    return {
        "a1_read_leads_csv": _sql("leads", f"SELECT {leads_cols} FROM leads"),
        "a1_read_mixed_csv": _sql("leads", f"""SELECT {leads_cols} FROM (SELECT * REPLACE (CASE WHEN CAST(substr(lead_id, 6) AS BIGINT) % 3 = 0
            THEN concat(lead_source, chr(10), 'by "phone", twice', chr(10), 'and mail') ELSE lead_source END AS lead_source) FROM leads)"""),
        "a2_require_columns": _sql("leads", "SELECT count(*) AS leads FROM leads"),
        "a3_coerce_dates": _sql("leads", f"SELECT lead_id, {date_case} FROM leads"),
        "a4_export_series_csv": _sql("points", """SELECT series_id, month, strftime(month, '%b %Y') AS date_text,
            '$' || format('{:,}', CAST(round(revenue, 0) AS BIGINT)) AS revenue_text,
            CASE type WHEN 'forecast' THEN 'Forecast' ELSE 'Historical' END AS type_text, CAST(bookings AS VARCHAR) AS bookings_text FROM points"""),
        "a5_write_forecast_json": _sql("fc", f"SELECT series_id, strftime(month, '%Y-%m-%d') AS date, {_r('forecast, lower, upper', 2)} FROM fc"),
        "a6_artifact_store": _sql("seg flat", f"""SELECT {rates_cols}, false AS is_flat FROM seg
            UNION ALL SELECT stage, NULL, NULL, completed, total, round(rate, 6), true FROM flat"""),
        "a7_saved_forecasts": _sql("tp_fc tl_fc", """SELECT 's1' AS id, 'first' AS name, '2001-08-01 10:00' AS saved, 'ana' AS created_by, series_id,
            CAST(count(*) AS INT) AS points, round(sum(forecast), 2) AS total FROM tp_fc GROUP BY series_id
            UNION ALL SELECT 's2', 'linear', '2001-08-02 10:00', 'bo', series_id, CAST(count(*) AS INT), round(sum(forecast), 2) FROM tl_fc GROUP BY series_id"""),
        "b1_completed_trips": _sql("leads", "SELECT lead_id, destination, trip_date, trip_price FROM leads WHERE current_stage='completed' AND trip_date IS NOT NULL"),
        "b2_as_of_cutoff": _sql("done", "SELECT lead_id, destination, trip_date, trip_price FROM done"),
        "b3_active_leads": _sql("leads", f"""SELECT lead_id, inquiry_date, current_stage, trip_price FROM leads
            WHERE inquiry_date <= {AS_OF} AND current_stage IN ('inquiry','quote_sent','booked','final_payment')"""),
        "b4_reclassify_future_trips": _sql("open_leads", "SELECT lead_id, inquiry_date, trip_date, current_stage, trip_price FROM open_leads"),
        "b5_resolved_leads": _sql("resolved", "SELECT lead_id, current_stage, converted FROM resolved"),
        "b6_inquiry_cohort": _sql("cohort", "SELECT lead_id, inquiry_date, current_stage FROM cohort"),
        "b7_filter_series": _sql("points", """SELECT series_id, month, type, round(revenue, 2) AS revenue FROM points
            WHERE month BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'"""),
        "b8_mask_for_role": _sql("said drivers", """SELECT 'admin' AS role, series_id, array_to_string(said.l[1:5], ' / ') AS insights,
            array_to_string(drivers.l[1:5], ' / ') AS key_drivers FROM said JOIN drivers USING (series_id)
            UNION ALL SELECT 'analyst', series_id, '', '' FROM said"""),
        "b9_funnel_visibility": _sql("leads", """SELECT current_stage AS stage, count(*) AS count,
            round(CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE), 4) AS revenue_potential,
            CAST(CASE current_stage WHEN 'inquiry' THEN 1 WHEN 'quote_sent' THEN 2 WHEN 'booked' THEN 3 WHEN 'final_payment' THEN 4
              WHEN 'completed' THEN 5 WHEN 'lost' THEN 6 ELSE 7 END AS INT) AS stage_no,
            CASE current_stage WHEN 'inquiry' THEN 'Inquiry' WHEN 'quote_sent' THEN 'Quote Sent' WHEN 'booked' THEN 'Booked'
              WHEN 'final_payment' THEN 'Final Payment' WHEN 'completed' THEN 'Completed' ELSE 'Lost' END AS stage_label
            FROM leads WHERE current_stage <> 'cancelled' GROUP BY current_stage"""),
        "b10_lead_features": _sql("leads", """SELECT lead_id, duration_days, is_repeat_customer, CAST(extract(month FROM inquiry_date) AS INT) AS inquiry_month,
            CAST(extract(quarter FROM inquiry_date) AS INT) AS inquiry_quarter, CAST(extract(year FROM inquiry_date) AS INT) AS inquiry_year,
            CAST(extract(month FROM inquiry_date) IN (1,2,3,9,10) AS INT) AS is_peak_season FROM leads"""),
        "c1_fill_missing_months": _sql("filled", f"SELECT {series} FROM filled"),
        "c2_ensemble_merge": _sql("ens", f"SELECT {bands}, 'ensemble' AS method FROM ens"),
        "c3_lookup_conversion_rate": _sql("looked", "SELECT lead_id, current_stage, round(conversion_rate, 6) AS conversion_rate, tier FROM looked"),
        "c3_tier_usage": _sql("looked", "SELECT tier, count(*) AS leads FROM looked GROUP BY 1"),
        "c4_monthly_bookings": _sql("bookings", f"SELECT {series}, bookings FROM bookings"),
        "c5_encode_category": _sql("leads resolved", """SELECT lead_id, l.lead_source, CAST(coalesce(c.code, 0) AS INT) AS lead_source_code FROM leads l
            LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 code FROM (SELECT DISTINCT coalesce(lead_source,'Unknown') v FROM resolved)) c
            ON c.v = coalesce(l.lead_source, 'Unknown')"""),
        "c6_new_categories": _sql("new_periods", "SELECT period AS category FROM new_periods"),
        "d1_monthly_revenue": _sql("monthly", f"SELECT {series} FROM monthly"),
        "d1_supplier_series": _sql("supplier_monthly", f"SELECT {series} FROM supplier_monthly"),
        "d2_history_span": _sql("leads", """SELECT destination, min(trip_date) AS first_trip, max(trip_date) AS last_trip,
            round((max(trip_date)-min(trip_date))/365.25::DOUBLE, 6) AS years, (max(trip_date)-min(trip_date))/365.25 >= 1 AS eligible
            FROM leads WHERE current_stage='completed' AND trip_date IS NOT NULL GROUP BY 1"""),
        "d3_load_metadata": _sql("stat", """SELECT total AS total_records, completed AS completed_trips, round(revenue, 4) AS total_revenue,
            round(average_price, 4) AS avg_trip_price, round(completed/total, 6) AS conversion_rate FROM stat WHERE series_id='ALL'"""),
        "d4_stage_distribution": _sql("leads", "SELECT current_stage, count(*) AS leads FROM leads GROUP BY 1"),
        "d4_completion_rate": _sql("stat", "SELECT series_id AS destination, completed, total, rate FROM stat WHERE series_id<>'ALL'"),
        "d5_revenue_stats": _sql("leads", revenue_stats("")),
        "d5_revenue_stats_by_destination": _sql("leads", revenue_stats("destination")),
        "d6_monthly_revenue_stats": _sql("hist", monthly_stats("stddev_samp")),
        "d7_destination_distribution": _sql("leads", "SELECT destination, count(*) AS leads FROM leads GROUP BY 1"),
        "d8_lead_source_distribution": _sql("leads", "SELECT lead_source, count(*) AS leads FROM leads GROUP BY 1"),
        "d9_open_lead_stats": _sql("open_leads", """SELECT current_stage, count(*) AS leads,
            round(CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE), 4) AS value FROM open_leads GROUP BY ROLLUP (current_stage)"""),
        "d10_missing_values": _sql("leads", " UNION ALL ".join(
            f"SELECT '{c.strip()}' AS column_name, count(*) - count({c.strip()}) AS missing FROM leads" for c in leads_cols.split(","))),
        "d11_duplicate_records": _sql("leads", """SELECT CAST(sum(n-1) AS BIGINT) AS duplicate_records FROM (
            SELECT count(*) n, lead_id, inquiry_date, destination, trip_price, lead_source, current_stage, is_repeat_customer, quote_date, booking_date, trip_date, final_payment_date, duration_days FROM (FROM leads UNION ALL FROM leads WHERE CAST(substr(lead_id, 6) AS BIGINT) % 10 = 0) GROUP BY ALL)"""),
        "d12_date_ranges": _sql("leads", """SELECT min(inquiry_date) AS inquiry_start, max(inquiry_date) AS inquiry_end, min(trip_date) AS trip_start,
            max(trip_date) AS trip_end, round_even((max(trip_date)-min(trip_date))/365.25::DOUBLE, 2) AS trip_span_years FROM leads"""),
        "d13_funnel_date_range": _sql("leads", "SELECT min(inquiry_date) AS min_date, max(inquiry_date) AS max_date FROM leads"),
        "d14_flat_conversion_rates": _sql("flat", "SELECT stage, completed, total, round(rate, 6) AS rate FROM flat"),
        "d15_segment_conversion_rates": _sql("seg", f"SELECT {rates_cols} FROM seg"),
        "d16_conversion_summary": _sql("seg", "SELECT count(rate) AS kept_segments, count(*) AS total_segments, 20 AS min_segment_size FROM seg"),
        "d17_funnel_cohort": _sql("funnel", "SELECT destination, stage_no, stage, count, round(revenue_potential, 4) AS revenue_potential FROM funnel"),
        "d18_funnel_current": _sql("current", "SELECT destination, stage_no, stage, count, round(revenue_potential, 4) AS revenue_potential FROM current"),
        "d19_funnel_rates": _sql("funnel", funnel_rates("funnel", "destination")),
        "d19_funnel_rates_current": _sql("current_all", funnel_rates("current_all", "")),
        "d20_funnel_summary": _sql("funnel", """SELECT destination, CAST(sum(count) AS BIGINT) AS total_count,
            round(max(count) FILTER (stage_no=5)/max(count) FILTER (stage_no=1)*100, 6) AS overall_pct, round(sum(revenue_potential), 2) AS total_potential,
            round(sum(step)/4, 6) AS mean_step_pct FROM (SELECT *, count/lag(count) OVER (PARTITION BY destination ORDER BY stage_no)*100 step FROM funnel) GROUP BY 1"""),
        "d21_open_value_details": _sql("looked", """SELECT current_stage, lead_source, is_repeat_customer, count(*) AS leads,
            round(CAST(sum(CAST(trip_price AS DECIMAL(18,2))) AS DOUBLE), 2) AS value, round(sum(trip_price*conversion_rate), 2) AS weighted_revenue,
            CASE WHEN grouping(current_stage)=1 THEN 'total' WHEN grouping(lead_source)=1 THEN 'stage' ELSE 'segment' END AS level
            FROM looked GROUP BY GROUPING SETS ((), (current_stage), (current_stage, lead_source, is_repeat_customer))"""),
        "d22_forecast_summary": _sql("fc", """SELECT series_id, round(sum(forecast), 2) AS total_forecast, round(avg(forecast), 2) AS average_monthly,
            round(min(forecast), 2) AS min_monthly, round(max(forecast), 2) AS max_monthly, round(stddev_samp(forecast), 2) AS std_monthly,
            round(CASE WHEN avg(forecast)>0 THEN stddev_samp(forecast)/avg(forecast) ELSE 0 END, 6) AS coefficient_of_variation FROM fc GROUP BY 1"""),
        "d23_horizon_kpis": _sql("fcn hist tp_fc", """SELECT series_id, round(tot, 2) AS total_forecast, round(f1, 2) AS forecast_1mo, round(f3, 2) AS forecast_3mo,
            round(f6, 2) AS forecast_6mo, round(hm, 2) AS historical_mean, round(base, 2) AS baseline_total, round(tot/12, 2) AS avg_12mo,
            round(tot-base, 2) AS diff, round((tot-base)/base*100, 6) AS diff_pct, round((f1-hm)/hm*100, 6) AS compare_1mo,
            round((f3/3-hm)/hm*100, 6) AS compare_3mo, round((f6/6-hm)/hm*100, 6) AS compare_6mo FROM
            (SELECT series_id, sum(forecast) tot, sum(forecast) FILTER (i<=1) f1, sum(forecast) FILTER (i<=3) f3, sum(forecast) FILTER (i<=6) f6 FROM fcn GROUP BY 1)
            JOIN (SELECT series_id, avg(revenue) hm FROM hist GROUP BY 1) USING (series_id)
            JOIN (SELECT series_id, sum(forecast) base FROM tp_fc GROUP BY 1) USING (series_id)"""),
        "d24_series_stats_population": _sql("hist", monthly_stats("stddev_pop")),
        "d25_executive_growth": _sql("points", """SELECT series_id, round(f, 2) AS total_forecast, round(h, 2) AS total_historical, round(f/12, 2) AS average_monthly,
            round((f-h)/h*100, 6) AS growth_pct FROM (SELECT series_id, sum(revenue) FILTER (type='forecast') f, sum(revenue) FILTER (type='historical') h FROM points GROUP BY 1)"""),
        "d26_forecast_vs_history": _sql("points", """SELECT series_id, round(f, 2) AS forecast_mean, round(h, 2) AS historical_mean, round((f-h)/h*100, 6) AS growth_pct
            FROM (SELECT series_id, avg(revenue) FILTER (type='forecast') f, avg(revenue) FILTER (type='historical') h FROM points GROUP BY 1)"""),
        "d27_quarterly_forecast": _sql("fcn", """SELECT q.series_id, quarter, round(total, 2) AS total, round(average, 2) AS average, round((q4-q1)/q1*100, 6) AS q1_to_q4_pct FROM
            (SELECT series_id, CAST((i+2)//3 AS INT) AS quarter, sum(forecast) total, avg(forecast) average FROM fcn GROUP BY 1, 2) q
            JOIN (SELECT series_id, avg(forecast) FILTER (i<=3) q1, avg(forecast) FILTER (i>9) q4 FROM fcn GROUP BY 1) g ON q.series_id=g.series_id"""),
        "d28_peak_trough": _sql("fc", """SELECT series_id, arg_max(month, forecast) AS peak_month, round(max(forecast), 2) AS peak_value,
            arg_min(month, forecast) AS trough_month, round(min(forecast), 2) AS trough_value FROM fc GROUP BY 1"""),
        "d29_trend_class": _sql("fcn", """SELECT series_id, round(a, 2) AS first_mean, round(b, 2) AS last_mean, round((b-a)/a*100, 6) AS trend_pct,
            CASE WHEN (b-a)/a*100 > 5 THEN 'INCREASING' WHEN (b-a)/a*100 < -5 THEN 'DECREASING' ELSE 'STABLE' END AS trend
            FROM (SELECT series_id, avg(forecast) FILTER (i<=3) a, avg(forecast) FILTER (i>=10) b FROM fcn GROUP BY 1)"""),
        "d30_volatility_class": _sql("fc", """SELECT series_id, round(cv, 6) AS cv_pct, CASE WHEN cv > 20 THEN 'HIGH' WHEN cv > 10 THEN 'MODERATE' ELSE 'LOW' END AS volatility
            FROM (SELECT series_id, stddev_samp(forecast)/avg(forecast)*100 cv FROM fc GROUP BY 1)"""),
        "d31_top_category": _sql("leads", " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS top, count(*) AS leads FROM leads WHERE {c} IS NOT NULL
            GROUP BY {c} ORDER BY leads DESC, top LIMIT 1)""" for c in ("lead_source", "destination"))),
        "d32_classification_metrics": _sql("ranked", """SELECT is_test, tp, fp, fn, tn, tp+fp+fn+tn AS samples, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy,
            round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END, 6) AS recall,
            round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, round((rs - p*(p+1)/2.0)/(p*q), 6) AS roc_auc FROM (
            SELECT is_test, count(*) FILTER (converted=1 AND score>0.5) tp, count(*) FILTER (converted=0 AND score>0.5) fp,
              count(*) FILTER (converted=1 AND score<=0.5) fn, count(*) FILTER (converted=0 AND score<=0.5) tn,
              CAST(sum(mid) FILTER (converted=1) AS DOUBLE) rs, count(*) FILTER (converted=1)::DOUBLE p, count(*) FILTER (converted=0)::DOUBLE q FROM ranked GROUP BY 1)"""),
        "d33_backtest_metrics": _sql("backtest", """SELECT series_id, round(avg(mape), 6) AS mape, round(avg(mae), 2) AS mae, round(avg(sqrt(mse)), 2) AS rmse, round(avg(mse), -3) AS mse
            FROM (SELECT series_id, h, avg(CASE WHEN actual>0 THEN abs(forecast-actual)/actual END) mape, avg(abs(forecast-actual)) mae, avg(power(forecast-actual, 2)) mse
            FROM backtest GROUP BY 1, 2) GROUP BY 1"""),
        "e1_trailing_nonzero_mean": _sql("tail_mean", f"SELECT series_id, {_r('mean_trips, mean_revenue')} FROM tail_mean"),
        "e2_flag_incomplete_months": _sql("flagged", f"SELECT {series}, rn_desc, incomplete FROM flagged"),
        "e3_trim_incomplete_tail": _sql("tailcut", f"SELECT {series} FROM tailcut"),
        "e4_drop_collapsed_last_month": _sql("hist", f"SELECT {series} FROM hist"),
        "e4_supplier_series": _sql("sup_hist", f"SELECT {series} FROM sup_hist"),
        "e5_drop_anomalous_last_month": _sql("filled_post", f"SELECT {series} FROM filled_post"),
        "e6_recent_stats": _sql("profile", f"""SELECT series_id, "months", last_month, {_r('last_revenue, hist_mean, hist_std, hist_max, plain_mean_6, plain_mean_12, '
            'recent_mean_6, recent_mean_12, recent_std_12')} FROM profile"""),
        "e7_growth_mode": _sql("tp_growth", "SELECT series_id, n AS months, logistic, round(CASE WHEN logistic THEN cap END, 4) AS cap FROM tp_growth"),
        "e8_month_over_month": _sql("fcn", """SELECT series_id, month, round(forecast, 2) AS forecast, round(CASE WHEN prev IS NOT NULL THEN
            CASE WHEN prev>0 THEN (forecast-prev)/prev*100 ELSE 0 END END, 6) AS mom_pct FROM fcn"""),
        "e9_deviation_from_mean": _sql("fc", """SELECT series_id, month, CASE WHEN forecast>m THEN 'ABOVE AVG' WHEN forecast<m THEN 'BELOW AVG' ELSE 'AT AVG' END AS vs_mean,
            round(CASE WHEN m>0 THEN (forecast-m)/m*100 ELSE 0 END, 6) AS deviation_pct FROM (SELECT *, avg(forecast) OVER (PARTITION BY series_id) m FROM fc)"""),
        "e10_ewm_smooth": _sql("hist", """, hn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) i FROM hist)
            SELECT a.series_id, a.month, round(sum(b.revenue * CASE WHEN b.i=1 THEN power(0.3, a.i-1) ELSE 0.7*power(0.3, a.i-b.i) END), 2) AS smoothed
            FROM hn a JOIN hn b ON a.series_id=b.series_id AND b.i<=a.i GROUP BY 1, 2"""),
        "e11_seeded_variation": _sql("seas1 z", f"""SELECT s.series_id, s.month, round(forecast*least(greatest(1+0.5*{_HCV}*z, 0.7), 1.3), 2) AS component,
            round(greatest(forecast*(1+least(greatest(0.4*{_CV}*z, -0.25), 0.25)), 0), 2) AS ensemble FROM seas1 s JOIN z USING (i)"""),
        "e12_transition_blend": _sql("seas1", """SELECT series_id, month, round(g, 2) AS forecast, round(CASE WHEN jump THEN greatest(0.7*g,0) ELSE lower END, 2) AS lower,
            round(CASE WHEN jump THEN greatest(1.3*g,0) ELSE upper END, 2) AS upper FROM (SELECT *, CASE WHEN jump AND i<=3 THEN last_revenue*(1-0.2*i)+forecast*0.2*i ELSE forecast END g
            FROM (SELECT *, CASE WHEN last_revenue>0 THEN f0/last_revenue > 1.3 ELSE true END jump FROM seas1))"""),
        "e13_dampen_start": _sql("damped2", f"SELECT {bands} FROM damped2"),
        "e14_cap_forecast": _sql("capped_e14", f"SELECT {bands} FROM capped_e14"),
        "e15_interval_rebuild": _sql("seas1", f"""SELECT series_id, month, round(forecast, 2) AS forecast, round(greatest(forecast*(1-{_CV}), 0), 2) + 0.0::DOUBLE AS lower,
            round(forecast*(1+{_CV}), 2) AS upper FROM seas1"""),
        "e16_chart_rows": _sql("points", """SELECT series_id, month, row_index, round(prev, 2) AS prev_revenue, round(CASE WHEN type='historical' THEN revenue END, 2) AS revenue_historical,
            round(CASE WHEN type='forecast' THEN revenue END, 2) AS revenue_forecast, round(lower, 2) AS band_low, round(upper, 2) AS band_high, round((upper-lower)/2, 2) AS half_width,
            strftime(month, '%b %Y') AS date_label, max(CASE WHEN type='historical' THEN row_index END) OVER (PARTITION BY series_id) AS transition_index FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS row_index, lag(revenue) OVER (PARTITION BY series_id ORDER BY month) prev FROM points)"""),
        "f1_category_codes": _sql("known_periods new_periods", """SELECT period AS category, code FROM known_periods
            UNION ALL SELECT period, (SELECT count(*) FROM known_periods) + row_number() OVER (ORDER BY period) - 1 FROM new_periods"""),
        "f2_stratified_split": _sql("split", "SELECT lead_id, converted, is_test FROM split"),
        "f3_first_tree": _sql("level4", """SELECT CAST(node AS INT) AS node, ['destination_code', 'lead_source_code', 'duration_days', 'is_repeat_customer', 'inquiry_month', 'inquiry_quarter', 'is_peak_season'][f] AS feature,
            round(cut, 6) AS cut, NULL::DOUBLE AS leaf_value FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1 UNION ALL SELECT * FROM best2 UNION ALL SELECT * FROM best3)
            UNION ALL SELECT CAST(node AS INT), NULL, NULL, round(-sum(0.5::DOUBLE - y)/(sum(0.25::DOUBLE) + 1)*0.1, 6) FROM level4 GROUP BY node"""),
        "a6_model_round_trip": _sql("level4", """SELECT CAST(node AS INT) AS node, ['destination_code', 'lead_source_code', 'duration_days', 'is_repeat_customer', 'inquiry_month', 'inquiry_quarter', 'is_peak_season'][f] AS feature,
            round(cut, 6) AS cut, NULL::DOUBLE AS leaf_value FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1 UNION ALL SELECT * FROM best2 UNION ALL SELECT * FROM best3)
            UNION ALL SELECT CAST(node AS INT), NULL, NULL, round(-sum(0.5::DOUBLE - y)/(sum(0.25::DOUBLE) + 1)*0.1, 6) FROM level4 GROUP BY node"""),
        "f4_expected_revenue": _sql("score_totals", """SELECT series_id, leads, round(open_value, 2) AS open_value, round(mean_probability, 6) AS mean_probability, round(total, 2) AS total FROM score_totals"""),
        "f5_rule_forecast": _sql("rule_totals", "SELECT series_id, leads, round(open_value, 2) AS open_value, round(total, 2) AS total FROM rule_totals"),
        "f6_spread_12_months": _sql("rules", f"SELECT {bands}, method FROM rules"),
        "f7_seasonal_trend": _sql("th_fc", f"SELECT {bands} FROM th_fc"),
        "f7_trend_changes": _sql("thc_fc", f"SELECT {bands} FROM thc_fc"),
        "f7_supplier_changes": _sql("tsc_growth tsc_line", "SELECT series_id, n AS months, CAST(kink AS INT) AS kink, round(bend, 2) AS bend FROM tsc_growth JOIN tsc_line USING (series_id)"),
        "f7_seasonal_trend_linear": _sql("thl_fc", f"SELECT {bands} FROM thl_fc"),
        "f7_supplier_trend": _sql("ts_fc", f"SELECT {bands} FROM ts_fc"),
        "f8_rolling_origin_backtest": _sql("backtest", "SELECT series_id, cutoff, h, month, round(forecast, 1) AS forecast, round(actual, 4) AS actual FROM backtest"),
        "f9_combine_ensemble": _sql("ensx", f"SELECT {bands}, 'ensemble' AS method FROM ensx"),
        "f10_forecast_12_months": _sql("fc", f"SELECT {bands}, 'ensemble' AS method FROM fc"),
        "f10_forecast_with_scores": _sql("fin3_fc", f"SELECT {bands}, 'ensemble' AS method FROM fin3_fc"),
        "g1_insights": _sql("said", "SELECT series_id, CAST(p-1 AS INT) AS place, l[p] AS sentence FROM said, range(1, 6) r(p) WHERE p <= len(l)"),
        "g2_key_drivers": _sql("drivers", "SELECT series_id, CAST(p-1 AS INT) AS place, l[p] AS sentence FROM drivers, range(1, 6) r(p) WHERE p <= len(l)"),
        "g3_report_completeness": _report_sql(),
        "g4_scenarios": _sql("fc", f"""SELECT series_id, month, scenario, round(factor, 6) AS factor, round(forecast*factor, 2) AS forecast, round(lower*factor, 2) AS lower,
            round(upper*factor, 2) AS upper FROM fc, {_scenario_values()}"""),
        "h1_sorted_points": _sql("points", "SELECT series_id, month, type, round(revenue, 2) AS revenue, bookings FROM points ORDER BY 1, 2"),
        "h2_top_categories": _sql("periods", "SELECT period, count(*) AS leads FROM periods GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "h2_top_destinations": _sql("leads", "SELECT destination, count(*) AS leads FROM leads GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "h3_last_months": _sql("hist", f"SELECT {series} FROM hist QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY month DESC) <= 6"),
        "h4_first_forecast_months": _sql("fcn", "SELECT series_id, month, round(forecast, 2) AS forecast FROM fcn WHERE i <= 3"),
        "k1_stream_monthly_revenue": _sql("done", """SELECT series_id, CAST(date_trunc('month', trip_date) AS DATE) AS month,
            round(CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE), 4) AS revenue, count(*) AS trip_count FROM (
            SELECT unnest(['ALL', destination]) series_id, trip_date, trip_price * CASE WHEN inquiry_date >= DATE '2000-01-01' THEN 1 ELSE 2 END p FROM done) GROUP BY 1, 2"""),
    }
