"""From file paths to classified claim documents and folders to load."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import is_blank, sanitize_name
from claimweave.operators.latest import newest_per_key
from claimweave.vocabulary import CLASSIFIER_RULES, DOCUMENT_TYPES, OTHER, SUPPORTED_FILE


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(SUPPORTED_FILE)


def in_folder(path: Column) -> Column:
    return F.instr(path, "/") > 0


def folder_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def file_name_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def is_claim_form(file_name: Column) -> Column:
    lowered = F.lower(file_name)
    return lowered.contains("claim") & lowered.contains("form")


def document_type_of(file_name: Column) -> Column:
    lowered = F.lower(file_name)

    def matches(groups, banned):
        needed = [reduce(or_, [lowered.contains(word) for word in group]) for group in groups]
        return reduce(and_, needed + [~lowered.contains(word) for word in banned])

    rules = [(kind, matches(groups, banned)) for kind, groups, banned in CLASSIFIER_RULES]
    ladder = F.when(rules[0][1], rules[0][0])
    for kind, condition in rules[1:]:
        ladder = ladder.when(condition, kind)
    return ladder.otherwise(OTHER)


def template_id_of(document_type: Column) -> Column:
    """Template of a supported type, NULL for any other."""
    return F.when(document_type.isin(*DOCUMENT_TYPES), F.concat(document_type, F.lit("_V1")))


def list_documents(files: DataFrame, supported_only: bool = True) -> DataFrame:
    """Files inside folders with their top folder and file name."""
    path = F.col("relative_path")
    wanted = in_folder(path) & is_supported(path) if supported_only else in_folder(path)
    return files.filter(wanted).withColumn("folder", folder_of(path)).withColumn("file_name", file_name_of(path))


def classify_documents(listed: DataFrame) -> DataFrame:
    """Adds document type and template id; both are narrow projections of the file name."""
    typed = listed.withColumn("document_type", document_type_of(F.col("file_name")))
    return typed.withColumn("template_id", template_id_of(F.col("document_type")))


def find_claim_forms(files: DataFrame) -> DataFrame:
    """First claim-form path of every folder that has one; the file extension does not matter here."""
    listed = list_documents(files, supported_only=False)
    forms = listed.filter(is_claim_form(F.col("file_name")))
    return forms.groupBy("folder").agg(F.min("relative_path").alias("form_path"))


def inserted(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("action") == "INSERT")


def new_folders(changes: DataFrame) -> DataFrame:
    """Folders that got at least one supported file."""
    return list_documents(inserted(changes)).select("folder").distinct()


def touched_folders(changes: DataFrame) -> DataFrame:
    """Folders that got or lost at least one supported file."""
    return list_documents(changes.filter(F.col("action").isin("INSERT", "DELETE"))).select("folder").distinct()


def folders_to_reload(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Every listed file of the touched folders: one new file reloads its whole folder. Adaptive execution splits a hot folder."""
    listed = list_documents(listing, supported_only=False)
    return listed.join(folders.select("folder").distinct(), "folder", "left_semi").select(*listed.columns)


def pending_files(changes: DataFrame, processed: DataFrame) -> DataFrame:
    """Inserted paths that no run has taken yet."""
    waiting = inserted(changes).select("relative_path").distinct()
    return waiting.join(processed.select("relative_path").distinct(), ["relative_path"], "left_anti")


def submission_folder(patient_name: Column, reference: Column) -> Column:
    return F.concat_ws("_", sanitize_name(patient_name), sanitize_name(reference))


def check_submissions(submissions: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of each submission: the folder it goes to, or the first reason against it.

    `submissions` has submission_id, patient_name, claim_reference; `files` has submission_id, file_name.
    """
    per_submission = files.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.bool_or(is_claim_form(F.col("file_name"))).alias("has_form")
    )
    checked = submissions.join(per_submission, "submission_id", "left")
    # Texts shown for a rejected submission, in the order they are checked.
    reason = (
        F.when(is_blank(F.col("patient_name")), "Enter the patient name.")
        .when(is_blank(F.col("claim_reference")), "Enter the claim reference.")
        .when(F.coalesce("file_count", F.lit(0)) == 0, "Upload at least one document.")
        .when(~F.col("has_form"), "A claim form is required before submission.")
    )
    folder = submission_folder(F.col("patient_name"), F.col("claim_reference"))
    return checked.select(
        "submission_id",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
        F.when(reason.isNull(), folder).alias("folder"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
    )


def newest_changes(changes: DataFrame) -> DataFrame:
    """Newest change of every path."""
    return newest_per_key(changes, ["relative_path"], [F.col("modified_at").desc_nulls_last(), F.col("action")])


def current_listing(changes: DataFrame) -> DataFrame:
    """Directory listing out of a change log: what has not been deleted since."""
    return newest_changes(changes).filter(F.col("action") != "DELETE")
