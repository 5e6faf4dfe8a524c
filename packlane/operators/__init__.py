"""Relational operators over packages, entries, references and requests. None of them needs Python on the executors but scan, pack and nfc."""
