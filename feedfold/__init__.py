"""feedfold: personal-feed digests as Spark jobs.

Mail, calendar, reminder and message feeds held as tables or streams are cut to
time windows, capped, rolled up into threads, folded into budgeted digests and
turned into prompts.  Every operator is a function from DataFrame to DataFrame;
``by`` names the columns (such as ``account_id``) that separate the accounts.
With ``by=()`` the whole input is one account.
"""
