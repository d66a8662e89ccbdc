"""Résumés: skills, companies, schools and sections as tables; dictionaries come from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import BLOCK_NAMES, first_name
from .retrieval import small


def either_contains(a: Column, b: Column) -> Column:
    """Whether one of two names holds the other; blank names hold nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def skill_match(people: DataFrame, key: str, text: str, skills: list[str]) -> DataFrame:
    """(key, matched, percent) of rows that name a skill of a short list, in any letter case."""
    low = F.lower(text)
    hits = [F.when(either_contains(low, F.lit(s.lower())), 1).otherwise(0) for s in skills]
    out = people.select(key, F.aggregate(F.array(*hits), F.lit(0).cast("long"), lambda a, x: a + x).alias("matched"))
    return out.filter("matched > 0").withColumn("percent", F.round(F.least(100.0 * F.col("matched") / len(skills), F.lit(100.0)) + 1e-9, 1))


def match_projects(works: DataFrame, projects: DataFrame) -> DataFrame:
    """(person, project_id, work_id): each project's first work whose company holds the project's, or the other way round; null for none.

    works (person, work_id, company) and projects (person, project_id, company) meet within a person.
    """
    w = works.select("person", "work_id", F.lower(F.trim("company")).alias("_w"))
    met = projects.join(w, "person").filter(either_contains(F.lower(F.trim("company")), F.col("_w")))
    first = met.groupBy("person", "project_id").agg(F.min("work_id").alias("work_id"))
    return projects.select("person", "project_id").join(first, ["person", "project_id"], "left")


def company_key(name: Column) -> Column:
    """A company's name without brackets, blanks and punctuation, in lower case."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[(（][^()（）]*[)）]", "")
    return F.regexp_replace(plain, r"[\s\p{Punct}，。、；：！？“”‘’《》·]+", "")


#: Fixed value: a company that only lends its staff is no mark of quality.
LENT = "外派"


def company_lookup(people: DataFrame, companies: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """people (id, company) with the tag of the first of companies (place, name, tag) that it is, and whether it's known (good).

    Names are compared after clean-up: those in ASCII must be equal, others contained.  All companies are searched for in one pass over
    the people, or one for each `block_names`.
    """
    texts = people.withColumn("text", company_key(F.col("company")))
    names = companies.select("place", company_key(F.col("name")).alias("name"))
    out = first_name(texts, names, block_names).join(companies.select("place", "tag"), "place", "left")
    return out.select(*people.columns, "tag", (F.col("place").isNotNull() & ~F.contains(F.coalesce("company", F.lit("")), F.lit(LENT))).alias("good"))


def school_lookup(people: DataFrame, schools: DataFrame) -> DataFrame:
    """people (id, school) with the school_id and rank of the first school whose name, English name or alias is the same after clean-up.

    schools (school_id, name, english, alias, rank): alias holds several names with a plus sign between them.
    """
    names = F.array_union(F.array("name", "english"), F.split(F.coalesce("alias", F.lit("")), r"\+"))
    known = schools.select("school_id", "rank", F.explode(names).alias("_name")).select("school_id", "rank", company_key(F.col("_name")).alias("_key"))
    known = known.filter("_key != ''").groupBy("_key").agg(F.min(F.struct("school_id", "rank")).alias("_s"))
    out = people.withColumn("_key", company_key(F.col("school"))).join(small(known), "_key", "left")
    return out.select(*people.columns, F.col("_s.school_id").alias("school_id"), F.col("_s.rank").alias("rank"))


SECTIONS = "basic struct<name:string,gender:string,phone:string,tel:string,marital:string>, work array<struct<company:string,start:string>>, education array<struct<school:string,start:string>>"


def flattened(resumes: DataFrame) -> DataFrame:
    """Typed columns of résumés (id, raw) in JSON: recoded flags, the phone or else the telephone, first and last work, last school.

    Sections are ordered by their start; control characters within the JSON are blanks; a résumé that isn't JSON has null fields.
    """
    clean = F.regexp_replace("raw", r"[\x00-\x1f]", " ")
    x = resumes.select("id", F.from_json(clean, SECTIONS).alias("r")).select("id", "r.*")
    by_start = lambda c: F.array_sort(F.filter(c, lambda s: s["start"].isNotNull()), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    x = x.withColumns({"work": by_start(F.col("work")), "education": by_start(F.col("education"))})
    gender = F.when(F.col("basic.gender").isin("M", "男"), "male").when(F.col("basic.gender").isin("F", "女"), "female")
    married = F.when(F.col("basic.marital") == "Y", True).when(F.col("basic.marital") == "N", False)
    phone = F.coalesce(F.nullif(F.trim("basic.phone"), F.lit("")), F.nullif(F.trim("basic.tel"), F.lit("")))
    return x.select("id", F.col("basic.name").alias("name"), gender.alias("gender"), married.alias("married"), phone.alias("phone"), F.get("work", F.lit(0))["company"].alias("first_company"), F.try_element_at("work", F.lit(-1))["company"].alias("last_company"), F.try_element_at("education", F.lit(-1))["school"].alias("last_school"))


def highest_degree(education: DataFrame, ranks: DataFrame) -> DataFrame:
    """(person, degree) of education (person, degree): the highest by a table (degree, rank) of the caller."""
    known = education.join(small(ranks), "degree")
    best = Window.partitionBy("person").orderBy(F.desc("rank"), "degree")
    return known.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select("person", "degree", "rank")


def jd_relevance(tech: Column, required: list[str], preferred: list[str]) -> Column:
    """How much a technology matters to a job: by the first required skill that names it or is named by it, else the first preferred one.

    1 and 0.7 for the same name, 0.7 and 0.5 for a part of it; 0.1 for none.
    """
    low = F.lower(tech)

    def first(skills: list[str], same: float, part: float) -> Column:
        met = F.filter(F.array(*[F.lit(s.lower()) for s in skills]), lambda s: F.contains(s, low) | F.contains(low, s)) if skills else F.array().cast("array<string>")
        return F.when(F.size(met) > 0, F.when(F.get(met, F.lit(0)) == low, same).otherwise(part))

    return F.coalesce(first(required, 1.0, 0.7), first(preferred, 0.7, 0.5), F.lit(0.1))


def project_weights(projects: DataFrame, required: list[str], preferred: list[str]) -> DataFrame:
    """projects (techs, background, architecture, challenges, achievements, ...) with relevance, depth and weight.

    relevance is that of the technology that matters most, 0.3 for none; depth adds 0.2 each for background, architecture and up to three challenges,
    0.1 for up to three achievements; the weight of a project is one and a half times half the relevance, 0.3 of the depth and 0.2.  All are 1 at most.
    """
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 0.2).otherwise(0.0)
    most = lambda c, n: F.least(F.coalesce(F.size(c), F.lit(0)), F.lit(3)) * n
    relevance = F.coalesce(F.array_max(F.transform("techs", lambda x: jd_relevance(x, required, preferred))), F.lit(0.3))
    depth = F.least(given("background") + given("architecture") + most("challenges", 0.2) + most("achievements", 0.1), F.lit(1.0))
    out = projects.withColumns({"relevance": relevance, "depth": F.round(depth, 6)})
    return out.withColumn("weight", F.round(F.least((F.col("relevance") * 0.5 + F.col("depth") * 0.3 + 0.2) * 1.5, F.lit(1.0)), 6))


def match_score(techs: Column, required: list[str]) -> Column:
    """Percent of the required skills that some technology names or is named by, rounded down; 80 if none is required."""
    if not required:
        return F.lit(80)
    low = F.transform(F.coalesce(techs, F.array().cast("array<string>")), F.lower)
    met = F.filter(F.array(*[F.lit(s.lower()) for s in required]), lambda s: F.exists(low, lambda x: F.contains(x, s) | F.contains(s, x)))
    return F.floor(F.size(met) * 100 / len(required)).cast("int")


#: Codes of degrees.
DEGREES = {"94": "EMBA", "6": "MBA", "95": "MPA", "92": "专升本", "4": "专科", "90": "中专", "91": "中技", "86": "初中", "3": "博士", "10": "博士后", "1": "本科", "2": "硕士", "87": "职高", "89": "高中"}


def _look_up(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(""))


def degree_name(code: Column) -> Column:
    return F.when(code.isNull(), "").otherwise(_look_up(code.cast("string"), DEGREES))


def degree_code(name: Column) -> Column:
    """The code of a degree's name, without outer blanks, in any letter case."""
    return F.when(name.isNull(), "").otherwise(_look_up(F.trim(F.upper(name)), {v: k for k, v in DEGREES.items()}))


def birth(text: Column, this_year: Column | int) -> Column:
    """birth_dt, birthday and age of a birth date in full, partial or as seconds; months and days that can't be are 1, null without a year."""
    t = F.trim(text)
    t = F.when(t.rlike(r"^\d{10,}"), F.date_format(F.timestamp_seconds(F.left(t, F.lit(10)).cast("long")), "yyyy-MM-dd HH:mm:ss")).otherwise(t)
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("int")
    # the year is at the beginning; month and day follow the first four digits, with at most one character between
    year, month, day = number(r"^(\d{4})"), number(r"\d{4}.?(\d{1,2})"), number(r"\d{4}.?\d{0,2}.?(\d{1,2})")
    month, day = F.when(month.between(1, 12), month).otherwise(1), F.when(day.between(1, 31), day).otherwise(1)
    return F.when(
        year.isNotNull(),
        F.struct(F.format_string("%d-%02d-%02d", year, month, day).alias("birth_dt"), F.format_string("%02d%02d", month, day).alias("birthday"), (F.lit(this_year) - year).cast("int").alias("age")),
    )


def without_tags(text: Column) -> Column:
    """HTML tags as blanks."""
    return F.regexp_replace(text, r"""(?i)<[a-z0-9."=';,:+_/ -]+>""", " ")


def keywords(text: Column) -> Column:
    """Lower-case keywords between commas, semicolons, points, tabs and blanks; blanks between two characters that aren't letters part keywords too."""
    parted = F.regexp_replace(text, r"([^a-zA-Z])[ ]+([^a-zA-Z ])", "$1，$2")
    return F.filter(F.transform(F.split(F.coalesce(parted, F.lit("")), r"[\t,，；;. ]"), F.lower), lambda x: x != "")


def mobile(phone: Column) -> Column:
    """The mobile number in a phone field, without signs and the country's code; empty for none."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]+", ""), r"^0*86([0-9]{11})", "$1")
    return F.regexp_extract(digits, r"(1[3456789][0-9]{9})", 1)


#: Ends of the names of fields that a profile keeps.
KEPT_FIELDS = ("_fea", "_tks", "_nst", "_dt", "_int", "_flt", "_ltks", "_kwd", "_id")


def kept_fields(profile: Column) -> Column:
    """A profile (a map of names to texts) without fields of other names, and without features (_fea) that aren't above 0."""
    named = F.map_filter(profile, lambda k, v: k.rlike("(" + "|".join(KEPT_FIELDS) + ")$"))
    return F.map_filter(named, lambda k, v: ~k.rlike("_fea$") | F.coalesce(v.try_cast("double") > 0, F.lit(False)))
