"""Contract rules: each gives an array of issues, empty for a valid row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftline import fixed_values as fixed
from liftline.functions import text as X
from liftline.functions.calendar import (
    date_window,
    is_date_shape,
    is_instant,
    iso_date,
    parse_date,
)
from liftline.functions.issues import (
    ISSUES_TYPE,
    is_number,
    is_word,
    issue,
    issue_list,
    issues_of_items,
    join_path,
    no_issues,
    unless,
)

# --- Sites ---------------------------------------------------------------------


def site_id_rule(value: Column) -> Column:
    return is_number(value, 1, fixed.MAX_SAFE_INTEGER) & (value == F.floor(value))


def site_issues(site: Column | None = None) -> Column:
    """Rules of a site held in columns of its field names, or in a struct."""
    held = F.col if site is None else site.getField
    return issue_list(
        unless(site_id_rule(held("id")), "id", fixed.WRONG_ID),
        unless(X.is_slug(X.trim_all(held("slug"))), "slug", fixed.WRONG_SLUG),
        unless(~X.is_blank(held("name")), "name", fixed.WRONG_NAME),
        unless(is_number(held("latitude"), -90, 90), "latitude", fixed.WRONG_NUMBER),
        unless(is_number(held("longitude"), -180, 180), "longitude", fixed.WRONG_NUMBER),
    )


# --- Dates -----------------------------------------------------------------------


def date_issue(text: Column, path: str) -> Column:
    """The shape is reported before the calendar; null when the date is valid."""
    return (
        F.when(text.isNull(), issue(path, fixed.REQUIRED))
        .when(~is_date_shape(text), issue(path, fixed.DATE_FORMAT_MESSAGE))
        .when(parse_date(text).isNull(), issue(path, fixed.DATE_REAL_MESSAGE))
    )


# --- Metrics ---------------------------------------------------------------------


def _missing_branch(metric: Column, with_confidence: bool) -> Column:
    rule = metric["value"].isNull() & ~X.is_blank(metric["missingReason"])
    return rule & metric["confidence"].isNull() if with_confidence else rule


def _confidence_rule(metric: Column) -> Column:
    return is_word(metric["confidence"]["level"], fixed.CONFIDENCE_LEVELS) & ~X.is_blank(
        metric["confidence"]["note"]
    )


def metric_valid(metric: Column, value_rule: Column, with_confidence: bool = True) -> Column:
    """One of the two branches holds completely; anything between them is invalid."""
    available = (
        is_word(metric["dataStatus"], fixed.AVAILABLE_STATUSES)
        & value_rule
        & metric["missingReason"].isNull()
    )
    if with_confidence:
        available = available & _confidence_rule(metric)
    missing = (metric["dataStatus"] == fixed.MISSING) & _missing_branch(metric, with_confidence)
    return F.coalesce(available, F.lit(False)) | F.coalesce(missing, F.lit(False))


def _metric_list(metrics: list[tuple[str, Column, Column]], with_confidence: bool) -> Column:
    """One issue per broken metric of (path, metric, value rule), at the field that breaks it.

    What the rules ask of a metric is computed once, into an array of small structs; one
    expression then judges all of them. So the size of the plan and of the generated code
    does not multiply by the branches of the rules. That expression is not generated code,
    so it is left to rows of which a plain test, which is, says that a metric is broken.
    """
    facts, whole = [], F.lit(True)
    for path, metric, value_rule in metrics:
        fields = {
            "path": F.lit(path),
            "status": metric["dataStatus"],
            "empty": metric["value"].isNull(),
            "fits": F.coalesce(value_rule, F.lit(False)),
            "plain": metric["missingReason"].isNull(),
            "told": ~X.is_blank(metric["missingReason"]),
        }
        if with_confidence:
            fields["unsure"] = metric["confidence"].isNull()
            fields["sure"] = F.coalesce(_confidence_rule(metric), F.lit(False))
        facts.append(F.struct(*[c.alias(name) for name, c in fields.items()]))
        whole = whole & _metric_holds(fields, with_confidence)

    def judged(m: Column) -> Column:
        known, gone = is_word(m["status"], fixed.AVAILABLE_STATUSES), is_word(m["status"], [fixed.MISSING])
        fault = (
            F.when(~known & ~gone, F.struct(join_path(m["path"], "dataStatus").alias("path"), F.lit(fixed.WRONG_WORD).alias("message")))
            .when(known & ~m["fits"], F.struct(join_path(m["path"], "value").alias("path"), F.lit(fixed.WRONG_NUMBER).alias("message")))
            .otherwise(F.struct(m["path"].alias("path"), F.lit(fixed.WRONG_BRANCH).alias("message")))
        )
        return F.when(~_metric_holds(m, with_confidence), fault)

    faults = F.filter(F.transform(F.array(*facts), judged), lambda fault: fault.isNotNull())
    return F.when(whole, no_issues()).otherwise(faults)


def _metric_holds(facts: Column | dict[str, Column], with_confidence: bool) -> Column:
    """Whether one of the two branches holds completely, from the facts of a metric; never null."""
    known = is_word(facts["status"], fixed.AVAILABLE_STATUSES)
    gone = is_word(facts["status"], [fixed.MISSING])
    available, missing = known & facts["fits"] & facts["plain"], gone & facts["empty"] & facts["told"]
    if with_confidence:
        available, missing = available & facts["sure"], missing & facts["unsure"]
    return available | missing


def output_value_rule(name: str, value: Column) -> Column:
    if name in fixed.OUTPUT_BOUNDS:
        return is_number(value, *fixed.OUTPUT_BOUNDS[name])
    return is_word(value, fixed.RISK_LEVELS)


def wind_levels_rule(levels: Column) -> Column:
    """One to six levels, each with a height, a direction and a speed."""
    each = F.forall(
        levels,
        lambda w: is_number(w["altitudeMslM"], 0)
        & is_number(w["directionDeg"], 0, 360)
        & is_number(w["speedKmh"], 0),
    )
    return F.coalesce(F.size(levels).between(1, fixed.MAX_WIND_LEVELS) & each, F.lit(False))


def input_value_rule(name: str, value: Column) -> Column:
    if name in fixed.INPUT_BOUNDS:
        return is_number(value, *fixed.INPUT_BOUNDS[name])
    if name == "windByAltitude":
        return wind_levels_rule(value)
    return is_word(value, fixed.CONVERGENCE_SIGNALS)


def output_metric_issues(outputs: Column, path: str = "outputs") -> Column:
    return _metric_list(
        [
            (f"{path}.{name}", outputs[name], output_value_rule(name, outputs[name]["value"]))
            for name, _label, _unit in fixed.OUTPUT_PANEL
        ],
        True,
    )


def input_metric_issues(inputs: Column, path: str = "forecastInputs") -> Column:
    return _metric_list(
        [
            (f"{path}.{name}", inputs[name], input_value_rule(name, inputs[name]["value"]))
            for name, _label, _unit, _kind in fixed.INPUT_PANEL
        ],
        False,
    )


def nesting_issues(outputs: Column, path: str = "outputs") -> Column:
    """Longer distances cannot be likelier; tested on individually valid metrics only."""
    c100, c200, c300 = (outputs[f"chance{km}KmPct"] for km in (100, 200, 300))

    def usable(metric: Column, name: str) -> Column:
        return metric_valid(metric, output_value_rule(name, metric["value"])) & (
            metric["dataStatus"] != fixed.MISSING
        )

    facts = {f"ok{km}": usable(m, f"chance{km}KmPct") for km, m in ((100, c100), (200, c200), (300, c300))}
    facts |= {f"v{km}": m["value"] for km, m in ((100, c100), (200, c200), (300, c300))}
    facts["gone200"] = c200["dataStatus"] == fixed.MISSING

    def judged(m: Column) -> Column:
        return issue_list(
            F.when(
                m["ok100"] & m["ok200"] & (m["v100"] < m["v200"]),
                issue(f"{path}.chance100KmPct.value", fixed.CHANCE_100_200_MESSAGE),
            ),
            F.when(
                m["ok200"] & m["ok300"] & (m["v200"] < m["v300"]),
                issue(f"{path}.chance200KmPct.value", fixed.CHANCE_200_300_MESSAGE),
            ),
            F.when(
                m["gone200"] & m["ok100"] & m["ok300"] & (m["v100"] < m["v300"]),
                issue(f"{path}.chance100KmPct.value", fixed.CHANCE_100_300_MESSAGE),
            ),
        )

    # In an array of one, so that each verdict is computed once, and only where a value rises.
    once = F.array(F.struct(*[c.alias(name) for name, c in facts.items()]))
    rises = (facts["v100"] < facts["v200"]) | (facts["v200"] < facts["v300"]) | (facts["v100"] < facts["v300"])
    return F.when(rises, F.flatten(F.transform(once, judged))).otherwise(no_issues())


# --- Documents -------------------------------------------------------------------


def _provenance_issues(provenance: Column, path: str) -> list[Column]:
    return [
        unless(~X.is_blank(provenance[field]), f"{path}.{field}", fixed.WRONG_NAME)
        for field in ("source", "version")
    ]


def record_issues() -> Column:
    """All rules of a detailed forecast document held in columns of its field names."""
    identity = issue_list(
        unless(site_id_rule(F.col("siteId")), "siteId", fixed.WRONG_ID),
        unless(X.is_slug(X.trim_all(F.col("siteSlug"))), "siteSlug", fixed.WRONG_SLUG),
        date_issue(F.col("forecastDate"), "forecastDate"),
        unless(is_instant(F.col("generatedAt")), "generatedAt", fixed.WRONG_INSTANT),
        *_provenance_issues(F.col("provenance"), "provenance"),
        *_provenance_issues(F.col("forecastInputs.provenance"), "forecastInputs.provenance"),
        unless(
            is_instant(F.col("forecastInputs.sourceRunAt")),
            "forecastInputs.sourceRunAt",
            fixed.WRONG_INSTANT,
        ),
        unless(F.size("topDrivers") >= 1, "topDrivers", fixed.WRONG_COUNT),
    )
    drivers = issues_of_items(
        F.col("topDrivers"),
        lambda text, i: F.when(
            X.is_blank(text), issue(join_path("topDrivers", i.cast("string")), fixed.WRONG_NAME)
        ),
    )
    return F.concat(
        identity,
        drivers,
        output_metric_issues(F.col("outputs")),
        nesting_issues(F.col("outputs")),
        input_metric_issues(F.col("forecastInputs")),
    )


def under(path: Column, issues: Column) -> Column:
    """The issues of an object as issues of the whole it stands in."""
    return F.transform(
        issues, lambda i: F.struct(join_path(path, i["path"]).alias("path"), i["message"].alias("message"))
    )


def summary_issues(item: Column) -> Column:
    """All rules of one summary: its identity and the fields of its branch."""
    identity = issue_list(
        unless(is_word(item["availability"], ["available", fixed.MISSING]), "availability", fixed.WRONG_WORD),
        unless(site_id_rule(item["siteId"]), "siteId", fixed.WRONG_ID),
        unless(X.is_slug(X.trim_all(item["siteSlug"])), "siteSlug", fixed.WRONG_SLUG),
        date_issue(item["forecastDate"], "forecastDate"),
    )
    given = F.concat(
        issue_list(
            unless(is_instant(item["generatedAt"]), "generatedAt", fixed.WRONG_INSTANT),
            *_provenance_issues(item["provenance"], "provenance"),
        ),
        output_metric_issues(item["outputs"]),
        nesting_issues(item["outputs"]),
    )
    gone = unless(~X.is_blank(item["missingReason"]), "missingReason", fixed.WRONG_NAME)
    return issue_list(
        identity,
        F.when(item["availability"] == "available", given),
        F.when(item["availability"] == fixed.MISSING, gone),
    )


def day_issues(item: Column) -> Column:
    """All rules of one day of a strip."""
    chance = item["chance100KmPct"]
    rule = output_value_rule("chance100KmPct", chance["value"])
    return issue_list(
        date_issue(item["forecastDate"], "forecastDate"),
        _metric_list([("chance100KmPct", chance, rule)], True),
    )


def summary_count_issue(summaries: Column) -> Column:
    return unless(F.size(summaries).between(1, fixed.MAX_SUMMARY_SITES), "summaries", fixed.WRONG_COUNT)


def summary_batch_issues(summaries: Column, response_date: Column) -> Column:
    """Order rules of a summaries envelope, all inside its row.

    Each item is compared with the item before it, not with a running maximum.
    """

    def per_item(item: Column, i: Column) -> Column:
        earlier = F.slice(summaries, 1, i)
        previous_id = F.when(i == 0, F.lit(0)).otherwise(F.get(summaries, i - 1)["siteId"])
        at = lambda field: join_path("summaries", i.cast("string"), field)
        return issue_list(
            F.when(
                ~item["forecastDate"].eqNullSafe(response_date),
                issue(at("forecastDate"), fixed.SUMMARY_DATE_MESSAGE),
            ),
            F.when(
                F.exists(earlier, lambda e: e["siteId"] == item["siteId"]),
                issue(at("siteId"), fixed.SUMMARY_ID_MESSAGE),
            ),
            F.when(
                F.exists(earlier, lambda e: e["siteSlug"] == item["siteSlug"]),
                issue(at("siteSlug"), fixed.SUMMARY_SLUG_MESSAGE),
            ),
            F.when(
                item["siteId"] <= previous_id, issue(at("siteId"), fixed.SUMMARY_ORDER_MESSAGE)
            ),
        )

    return issue_list(summary_count_issue(summaries), issues_of_items(summaries, per_item))


def strip_frame_issues(zone: Column, today: Column, days: Column) -> Column:
    """The zone, today and the number of days of a strip."""
    return issue_list(
        unless(zone == fixed.FORECAST_ZONE, "timeZone", fixed.WRONG_ZONE),
        date_issue(today, "todayDate"),
        unless(F.size(days) == fixed.STRIP_DAYS, "days", fixed.WRONG_COUNT),
    )


def strip_issues(zone: Column, today: Column, days: Column) -> Column:
    """A strip has the fixed zone and exactly the five dates around ``today``.

    ``days`` is an array of date texts; the dates are tested when there are five.
    """
    expected = F.transform(date_window(parse_date(today), 2, 2), iso_date)
    wrong_dates = issues_of_items(
        expected,
        lambda date, i: F.when(
            ~F.get(days, i).eqNullSafe(date),
            issue(
                join_path("days", i.cast("string"), "forecastDate"),
                F.format_string(fixed.STRIP_DATE_MESSAGE, date),
            ),
        ),
    )
    complete = F.size(days) == fixed.STRIP_DAYS
    return issue_list(strip_frame_issues(zone, today, days), F.when(complete, wrong_dates))


# --- Requests --------------------------------------------------------------------


def parse_slug_list(text: Column) -> Column:
    """One comma-separated text to trimmed slugs, kept in order."""
    return F.transform(F.split(text, ",", -1), lambda item: X.trim_all(item))


_ITEM = (
    rf"[{X.BLANKS}]*(?=[a-z0-9-]{{1,{fixed.SLUG_MAX_LENGTH}}}(?![a-z0-9-]))"
    rf"[a-z0-9]+(?:-[a-z0-9]+)*[{X.BLANKS}]*"
)
_LIST = rf"^{_ITEM}(?:,{_ITEM}){{0,{fixed.MAX_SUMMARY_SITES - 1}}}\z"


def _parts_without_blanks(text: Column) -> Column:
    """The items of a valid list: there is no white space inside a valid item."""
    return F.split(F.translate(text, X.BLANKS, ""), ",", -1)


def slug_list_valid(text: Column) -> Column:
    """The list gives no issue, tested on the text itself.

    A filter on the parsed list would be pushed below the parsing and repeat it. A
    pattern and a plain split of the text stay within generated code.
    """
    parts = _parts_without_blanks(text)
    return F.coalesce(
        text.rlike(_LIST) & (F.size(F.array_distinct(parts)) == F.size(parts)), F.lit(False)
    )


def slug_list_issues(slugs: Column, path: str = "siteSlugs") -> Column:
    """Each item a slug, one to seven of them; uniqueness is tested on valid items."""
    bad_items = issues_of_items(
        slugs,
        lambda s, i: F.when(
            ~X.is_slug(s), issue(join_path(path, i.cast("string")), fixed.WRONG_SLUG)
        ),
    )
    repeated = ~F.exists(slugs, lambda s: ~X.is_slug(s)) & (
        F.size(F.array_distinct(slugs)) < F.size(slugs)
    )
    whole = issue_list(
        unless(F.size(slugs) <= fixed.MAX_SUMMARY_SITES, path, fixed.WRONG_COUNT),
        F.when(repeated, issue(path, fixed.UNIQUE_SLUGS_MESSAGE)),
    )
    return F.when(slugs.isNull(), issue(path, fixed.REQUIRED)).otherwise(
        F.concat(bad_items, whole)
    )


def valid_summary_requests(requests: DataFrame) -> DataFrame:
    """Requests (``date_text``, ``site_slugs``) that pass, with ``slugs`` and ``forecast_date``."""
    date = parse_date(F.col("date_text"))
    passed = requests.where(date.isNotNull() & slug_list_valid(F.col("site_slugs")))
    return passed.withColumns(
        {"slugs": _parts_without_blanks(F.col("site_slugs")), "forecast_date": date}
    )


def rejected_summary_requests(requests: DataFrame) -> DataFrame:
    """Requests that do not pass, with their ``issues``."""
    passed = parse_date(F.col("date_text")).isNotNull() & slug_list_valid(F.col("site_slugs"))
    parsed = requests.where(~passed).withColumn("slugs", parse_slug_list(F.col("site_slugs")))
    return parsed.withColumn(
        "issues",
        issue_list(date_issue(F.col("date_text"), "date"), slug_list_issues(F.col("slugs"))),
    )


def slug_issue(text: Column, path: str) -> Column:
    """A request names a slug, with blanks around it or not."""
    return F.when(text.isNull(), issue(path, fixed.REQUIRED)).otherwise(
        unless(X.is_slug(X.trim_all(text)), path, fixed.WRONG_SLUG)
    )


def site_request_issues(with_date: bool) -> Column:
    """Rules of the detail route (``site_slug``, ``date_text``) or the days route (``site_slug``)."""
    rules = [slug_issue(F.col("site_slug"), "siteSlug")]
    if with_date:
        rules.append(date_issue(F.col("date_text"), "date"))
    return issue_list(*rules)


def valid_site_requests(requests: DataFrame, with_date: bool) -> DataFrame:
    """Requests that pass, with the trimmed ``slug`` and, for the detail route, ``forecast_date``."""
    slug, date = X.trim_all(F.col("site_slug")), parse_date(F.col("date_text")) if with_date else None
    rule = X.is_slug(slug) & date.isNotNull() if with_date else X.is_slug(slug)
    passed = requests.where(rule).withColumn("slug", slug)
    return passed.withColumn("forecast_date", date) if with_date else passed


def unknown_field_issue(json: Column, allowed: list[str], path: str = "$") -> Column:
    """Extra keys of one JSON object, reported at the object."""
    extra = F.array_except(
        F.json_object_keys(json), F.array(*[F.lit(name) for name in allowed])
    )
    return F.when(
        F.size(extra) > 0,
        issue(path, F.format_string(fixed.UNKNOWN_FIELD, F.array_join(F.array_sort(extra), ", "))),
    )


def issue_rows(rows: DataFrame, keys: list[str], issues: str = "issues") -> DataFrame:
    """One row per issue; an empty path is the root ``$``.

    The outer form is used because the plain one adds a filter on the size of the
    array, which would be pushed below the rules and evaluate them twice.
    """
    flat = rows.select(*keys, F.posexplode_outer(issues).alias("issue_pos", "issue")).where(
        "issue_pos IS NOT NULL"
    )
    path = F.when(F.col("issue.path") == "", "$").otherwise(F.col("issue.path"))
    return flat.select(*keys, "issue_pos", path.alias("path"), F.col("issue.message").alias("message"))


def split_by_issues(rows: DataFrame, issues: str = "issues") -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows; the latter keep their issues."""
    valid = F.size(issues) == 0
    return rows.where(valid).drop(issues), rows.where(~valid)


# --- Problems --------------------------------------------------------------------


def problem_type(code: Column, namespace: str) -> Column:
    """``urn:<namespace>:problem:<code in lower case with dashes>``."""
    return F.concat(
        F.lit(f"urn:{namespace}:problem:"), F.replace(F.lower(code), F.lit("_"), F.lit("-"))
    )


def _code_value(code: Column, index: int) -> Column:
    pairs = [F.lit(v) for row in fixed.PROBLEM_CODES for v in (row[0], row[index])]
    return F.try_element_at(F.create_map(*pairs), code)


def with_problem(rows: DataFrame, code: str, namespace: str) -> DataFrame:
    """Adds ``type``, ``title`` and ``status`` of a problem code."""
    key = F.col(code)
    return rows.withColumns(
        {
            "type": problem_type(key, namespace),
            "title": _code_value(key, 1),
            "status": _code_value(key, 2),
        }
    )


def problem_issues(namespace: str, problem: Column | None = None) -> Column:
    """A reject row (or struct) agrees with its code on type, title and status and has a detail."""
    held = F.col if problem is None else problem.getField
    code = held("code")
    expected = {
        "type": problem_type(code, namespace),
        "title": _code_value(code, 1),
        "status": _code_value(code, 2),
    }
    known = is_word(code, [row[0] for row in fixed.PROBLEM_CODES])
    return issue_list(
        unless(known, "code", fixed.WRONG_WORD),
        *[
            F.when(
                known & ~held(field).eqNullSafe(value),
                issue(field, F.format_string(fixed.PROBLEM_FIELD_MESSAGE, F.lit(field), code)),
            )
            for field, value in expected.items()
        ],
        unless(~X.is_blank(held("detail")), "detail", fixed.WRONG_NAME),
    )


def problem_envelope_issues(request_id: Column | None = None, issues: Column | None = None) -> Column:
    """The ``request_id`` of a problem, and its ``issues``: a message for each, a path if only empty."""
    request_id = F.col("request_id") if request_id is None else request_id
    each = issues_of_items(
        F.col("issues") if issues is None else issues,
        lambda item, i: issue_list(
            F.when(item["path"].isNull(), issue(join_path("issues", i.cast("string"), "path"), fixed.REQUIRED)),
            F.when(X.is_blank(item["message"]), issue(join_path("issues", i.cast("string"), "message"), fixed.WRONG_NAME)),
        ),
    )
    known = F.coalesce(request_id.rlike(fixed.REQUEST_ID_PATTERN), F.lit(False))
    return F.concat(issue_list(unless(known, "requestId", fixed.WRONG_REQUEST_ID)), each)
