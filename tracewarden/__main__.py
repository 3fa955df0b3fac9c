"""python -m tracewarden anonymize|analysis|measures|filter -f SPEC.json

Exit codes: 0 done, 1 no spec file, 2 it is no JSON, 3 a field is missing, 4 an input file does not exist, 5 the output folder
does not exist, 6 unknown method, 7 unknown command, 8 wrong parameter of a method or data it can't work on.
"""

from __future__ import annotations

import argparse
import json
import sys

from tracewarden.plans import registry
from tracewarden.session import session

COMMANDS = {"anonymize": registry.anonymize, "analysis": registry.analyze, "measures": registry.measure, "filter": registry.filter_dataset}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewarden", exit_on_error=False)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("-f", "--file", required=True)
    try:
        args = parser.parse_args(argv)
    except (argparse.ArgumentError, SystemExit):
        given = sys.argv[1:] if argv is None else argv
        return registry.NO_SPEC_FILE if given and given[0] in COMMANDS else registry.WRONG_COMMAND
    try:
        with open(args.file) as f:
            text = f.read()
    except OSError as e:
        print(e, file=sys.stderr)
        return registry.NO_SPEC_FILE
    try:
        out = COMMANDS[args.command](session(), text)
    except (TypeError, ValueError) as e:
        print(e, file=sys.stderr)
        return getattr(e, "code", registry.WRONG_PARAMETER)
    if isinstance(out, dict):
        print(json.dumps(out, indent=4))
    else:
        out.show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
