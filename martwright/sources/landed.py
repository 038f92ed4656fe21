"""Normalisers for API pages landed as files: all-string records in, typed tables out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num
from martwright.operators import joins
from martwright.session import stage

EVENT_SCHEMA = """safetyreportid string, receivedate string, serious string, companynumb string,
patient struct<patientonsetage: string, patientsex: string, patientweight: string,
  drug: array<struct<medicinalproduct: string, drugindication: string,
    openfda: struct<brand_name: array<string>, generic_name: array<string>>>>,
  reaction: array<struct<reactionmeddrapt: string>>>"""


def row_cap(df: DataFrame, max_records: int, *order) -> DataFrame:
    """The first ``max_records`` rows in a stated order."""
    return df.orderBy(*order).limit(max_records)


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Empty text becomes null, the rest is read as a number."""
    return df.withColumns({c: num.safe_numeric(num.blank_to_null(F.col(c))) for c in columns if c in df.columns})


def providers(raw: DataFrame, state: str | None = None, specialty: str | None = None) -> DataFrame:
    """Provider rows of known states, friendly names, numeric totals; identifiers stay text."""
    codes = [abbr for _, abbr, _ in rules.STATES]
    renamed = raw.select(*[F.nullif(F.col(a), F.lit("")).alias(b) for a, b in rules.PROVIDER_COLUMNS if a in raw.columns])
    kept = renamed.filter((F.col("country") == "US") & F.col("state").isin(codes))
    return numbers(joins.where_equal(kept, {"state": state, "provider_specialty": specialty}), *rules.PROVIDER_NUMERIC)


def measures(raw: DataFrame, question_id: str | None = None, year: str | None = None,
             data_value_type: str | None = "CRDPREV", overall_only: bool = True) -> DataFrame:
    """Indicator rows with a numeric value and a suppression flag; aggregate codes drop out."""
    kept = joins.where_equal(raw, {"questionid": question_id, "yearstart": year, "datavaluetypeid": data_value_type,
                                   "stratificationcategory1": "Overall" if overall_only else None})
    typed = numbers(joins.drop_codes(kept, "locationabbr", rules.EXCLUDED_LOCATIONS), "datavalue")
    mark = F.coalesce("datavaluefootnotesymbol", F.lit("")) if "datavaluefootnotesymbol" in raw.columns else F.lit("")
    return typed.withColumn("is_suppressed", F.col("datavalue").isNull() & (mark == "*"))


def survey(raw: DataFrame, topic: str | None = None, year: str | None = None, response: str | None = None,
           overall_only: bool = True) -> DataFrame:
    """Survey rows with a numeric value; national and territory codes drop out."""
    kept = joins.where_equal(raw, {"topic": topic, "year": year, "response": response,
                                   "break_out": "Overall" if overall_only else None})
    return numbers(joins.drop_codes(kept, "locationabbr", rules.EXCLUDED_LOCATIONS), "data_value")


def survey_preset(raw: DataFrame, preset: str, year: str = "2023") -> DataFrame:
    """A survey pull by its preset name."""
    return survey(raw, year=year, **rules.SURVEY_PRESETS.get(preset, {}))


def counties(raw: DataFrame, state_abbr: str | None = None, measure_id: str | None = None,
             data_value_type: str | None = "CrdPrv") -> DataFrame:
    """County rows without the national roll-up; county codes stay text."""
    kept = joins.where_equal(joins.drop_codes(raw, "stateabbr", ("US",)),
                             {"stateabbr": state_abbr, "measureid": measure_id, "datavaluetypeid": data_value_type})
    return numbers(kept, "data_value").withColumn("totalpop18plus", num.safe_numeric(F.col("totalpop18plus")).cast("long"))


def population(pages: DataFrame, rows: str = "rows") -> DataFrame:
    """Pages of string arrays whose first array is the header: name, population, code, abbreviation.

    Codes outside the crosswalk drop out.
    """
    record = F.explode(F.slice(F.col(rows), F.lit(2), F.size(rows)))
    flat = pages.select(F.element_at(rows, 1).alias("header"), record.alias("record"))
    by_name = F.map_from_arrays("header", "record")
    named = flat.select(F.try_element_at(by_name, F.lit("NAME")).alias("state_name"),
                        num.safe_numeric(F.try_element_at(by_name, F.lit("B01003_001E"))).cast("long").alias("population"),
                        F.try_element_at(by_name, F.lit("state")).alias("state_fips"))
    crosswalk = joins.state_crosswalk(pages.sparkSession).select("state_fips", "state_abbr")
    return joins.crosswalk_join(named, crosswalk, "state_fips", "inner").select("state_name", "population", "state_fips", "state_abbr")


def indicators(pages: DataFrame, indicator: str, countries: Iterable[str] | None = None) -> DataFrame:
    """Envelopes with a ``value`` list: unwrapped, renamed, optionally for some countries, labelled."""
    codes = {name: code for code, name in rules.INDICATOR_NAMES.items()}
    label = rules.INDICATOR_NAMES.get(codes.get(indicator, indicator), indicator)
    flat = pages.select(F.inline("value"))
    flat = flat.withColumnsRenamed({a: b for a, b in rules.INDICATOR_COLUMNS if a in flat.columns})
    wanted = list(countries or [])
    return (joins.keep_codes(flat, "country_code", wanted) if wanted else flat).withColumn("indicator_name", F.lit(label))


def flat_events(df: DataFrame, json: str) -> DataFrame:
    """Nested event records to one flat row each: the first drug, reactions joined, missing as empty text."""
    event = F.from_json(F.col(json), EVENT_SCHEMA)
    patient, drug = F.col("e.patient"), F.try_element_at(F.col("e.patient.drug"), F.lit(1))

    def text(c):
        return F.coalesce(c, F.lit(""))

    def joined(c):
        return text(F.array_join(c, "; "))

    reactions = F.transform(patient["reaction"], lambda r: text(r["reactionmeddrapt"]))
    return df.select(event.alias("e")).select(
        text(F.col("e.safetyreportid")).alias("safety_report_id"), text(F.col("e.receivedate")).alias("receive_date"),
        text(F.col("e.serious")).alias("serious"), text(F.col("e.companynumb")).alias("sender_organization"),
        text(patient["patientonsetage"]).alias("patient_age"), text(patient["patientsex"]).alias("patient_sex"),
        text(patient["patientweight"]).alias("patient_weight"), text(drug["medicinalproduct"]).alias("drug_name"),
        text(drug["drugindication"]).alias("drug_indication"), joined(drug["openfda"]["brand_name"]).alias("brand_name"),
        joined(drug["openfda"]["generic_name"]).alias("generic_name"), joined(reactions).alias("reactions"))


def measure_catalog(raw: DataFrame) -> DataFrame:
    """Distinct measures that publish crude prevalence, by topic and question; defaults when there are none."""
    found = stage(joins.where_equal(raw, {"datavaluetypeid": "CRDPREV"}).select("questionid", "question", "topic")
                  .dropna().distinct(), "catalog")
    if found.isEmpty():
        found = raw.sparkSession.createDataFrame(list(rules.DEFAULT_MEASURES), "questionid string, question string, topic string")
    return found.orderBy("topic", "question", "questionid")


