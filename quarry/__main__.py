"""The jobs as commands: ``python -m quarry COMMAND --flag value ...``."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from .operators import profile, qa, sft, split
from .plans import curate
from .sources import endpoint, files

NEEDED = object()


@dataclass(frozen=True)
class Command:
    run: Callable[..., Any]
    flags: dict[str, Any]  # a flag's default, NEEDED, or a type for a flag that may be left out


def _extract(spark, a):
    return curate.extract_documents(spark, a.input_dir, a.output, a.max_documents, files.optional_readers(a.ocr, a.ocr_languages))


def _inspect(spark, a):
    for part, rows in curate.inspect_corpus(spark, a.input, a.top, a.min_text_length).items():
        print(part, *(r.asDict() for r in rows.collect()), sep="\n  ")


def _generate(spark, a):
    ask = endpoint.endpoint(a.model, a.base_url, a.timeout)
    return curate.generate_qa_dataset(spark, a.input, a.output, ask, a.resume, a.max_documents, questions=a.questions_per_document, max_chars=a.max_chars, size=a.context_chars, least=a.min_grounding)


def _split(spark, a):
    return curate.split_dataset(spark, a.input, a.output_dir, a.seed, a.train_ratio, a.validation_ratio, a.max_documents)


COMMANDS = {
    "extract-documents": Command(_extract, {"input-dir": NEEDED, "output": "data/extracted/corpus.jsonl", "max-documents": int, "ocr": False, "ocr-languages": "rus+eng"}),
    "inspect-corpus": Command(_inspect, {"input": NEEDED, "top": profile.TOP, "min-text-length": profile.SHORT}),
    "generate-qa-dataset": Command(_generate, {
        "input": NEEDED, "output": NEEDED, "model": NEEDED, "base-url": endpoint.BASE_URL, "questions-per-document": qa.QUESTIONS, "max-documents": qa.MAX_DOCUMENTS,
        "max-chars": qa.MAX_CHARS, "timeout": endpoint.TIMEOUT, "context-chars": qa.CONTEXT_CHARS, "min-grounding": qa.MIN_GROUNDING, "resume": False,
    }),
    "prepare-dataset": Command(lambda spark, a: curate.prepare_dataset(spark, a.input, a.output), {"input": NEEDED, "output": NEEDED}),
    "split-dataset": Command(_split, {"input": NEEDED, "output-dir": "data/dataset", "seed": split.SEED, "train-ratio": split.TRAIN, "validation-ratio": split.VALIDATION, "max-documents": int}),
    "format-sft-dataset": Command(lambda spark, a: curate.format_sft_dataset(spark, a.input, a.output, a.max_context_chars), {"input": NEEDED, "output": NEEDED, "max-context-chars": sft.CONTEXT_CHARS}),
    "evaluate-generation": Command(lambda spark, a: curate.evaluate_generation(spark, a.predictions, a.output), {"predictions": NEEDED, "output": "evaluation/results.json"}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        one = commands.add_parser(name)
        for flag, default in command.flags.items():
            if default is False:
                one.add_argument(f"--{flag}", action="store_true")
            elif isinstance(default, type):
                one.add_argument(f"--{flag}", type=default)
            else:
                one.add_argument(f"--{flag}", required=default is NEEDED, type=str if default is NEEDED else type(default), default=None if default is NEEDED else default)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"quarry {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    said = COMMANDS[args.command].run(spark, args)
    if said is not None:
        print(said)


if __name__ == "__main__":
    main()
