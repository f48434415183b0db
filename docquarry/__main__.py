"""Command line: ``python -m docquarry search|read|list [argument] [--key value …]``."""

from __future__ import annotations

import argparse
import logging

from docquarry.plans.engine import Engine
from docquarry.session import build_session
from docquarry.settings import load_settings, log_settings

OPTIONS = (
    "content_dir", "uri_scheme", "cross_ref", "search.max_results", "search.result_mode", "search.in_memory",
    "search.keywords_boost", "search.heading_boost", "search.title_boost", "search.path_boost", "search.content_boost",
)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docquarry")
    parser.add_argument("action", choices=("search", "read", "list"))
    parser.add_argument("argument", nargs="?", default="")
    for option in OPTIONS:
        parser.add_argument("--" + option.replace(".", "-").replace("_", "-"), dest=option)
    given = vars(parser.parse_args(arguments))
    settings = load_settings({option: given[option] for option in OPTIONS if given[option] is not None})
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(name)s %(message)s")
    log_settings(settings)
    engine = Engine.open(build_session(), settings)
    if given["action"] == "search":
        print(engine.search_page(given["argument"]))
    elif given["action"] == "read":
        print(engine.read(given["argument"]))
    else:
        engine.resources().show(truncate=False)


if __name__ == "__main__":
    main()
