"""binframe: record-oriented binary data and corpora as Spark DataFrames."""
