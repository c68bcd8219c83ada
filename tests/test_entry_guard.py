"""The entry without the libraries that only the operators for training data need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_a_third_party_module():
    code = ("import sys, warnings; sys.modules['regex'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; "
            "q = e.queries(); assert not any(k.startswith('op') for k in q) and len(q) >= 92 and set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_query_has_an_oracle():
    from toxiscope.plans import catalog
    catalog.load_all()
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
