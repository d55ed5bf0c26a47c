"""python -m tracewarden FOLDER: audits one skill and prints its report as one line of JSON.

The texts of errors are fixed values.
"""

from __future__ import annotations

import json
import os
import sys


def main(args: list[str]) -> int:
    if not args:
        print(json.dumps({"error": "No skill path provided"}))
        return 1
    if not os.path.exists(args[0]):
        print(json.dumps({"error": f"Path does not exist: {args[0]}"}))
        return 1
    from tracewarden.operators import findings as fs
    from tracewarden.operators.corpus import skills
    from tracewarden.plans import audit
    from tracewarden.session import session
    from tracewarden.sources import skilltree

    spark = session("audit", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    skilltree.register(spark)
    files = spark.read.format("skilltree").option("single", "true").load(os.path.abspath(args[0])).persist()
    bad = skilltree.failed(files).first()
    if bad is not None:
        print(json.dumps({"error": bad["error"]}))
        return 1
    found = audit.findings(files).persist()
    print(fs.documents(skills(files), found).first()["report"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
