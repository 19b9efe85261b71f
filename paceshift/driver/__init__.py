"""The library's reports over the given star and event tables, with the SQL that checks them."""
