"""The registered queries and the SQL that they must agree with."""
