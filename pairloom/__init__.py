"""Text-pair analytics on PySpark: cleaning, pairing, lexicons, audits and scores."""
