"""The estate that the queries run on, derived from the given tables by one SQL text.

``text(name, dialect)`` gives the SELECT for Spark or DuckDB; both yield the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Orders whose workflow exports one task puts together, about.
EXPORT_ROWS = 50_000
BASE_TABLES = ("orders", "events", "customer", "part", "pages", "embeddings", "documents", "benchmark")

#: Texts of which a script has one (lines are parted by a bar), so that every rule has scripts that meet it.
SNIPPETS = [
    "ComponentAccessor.getIssueManager()", "def m = IssueManager", "UserManager um", "GroupManager gm", "CustomFieldManager fm", "WorkflowManager wm", "ProjectManager pm",
    "new FileWriter(\"out\")", "Files.write(path)", "EntityCondition c", "ofBizDelegator.find()", "x.getUsername()", "userKey = \"jdoe\"", "get(\"/rest/api/2/user?username=x\")",
    "getFieldById(\"x\").setHidden(true)", "f.setRequired(true)|f.setReadOnly(true)", "f.setError(\"no\")|f.setAllowedValues(v)", "MutableIssue i|issueManager.createIssueObject(m)",
    "VelocityTemplatingEngine e|velocity.getTemplate(\"a\")", "lfHide(\"customfield_10010\")", "ldap(\"x\")|ldapSearch(\"cn\")", "readFromTextFile(\"a\")|writeToTextFile(\"b\")", "readFromFile(\"c\")|sql(\"select 1\")",
    "GroupUtils.getGroupByName(\"a\")", "getGroupByName(\"b\")", "inGroup(\"c\")", "getUsersFromGroup(\"d\")", "isUserInGroup(u, \"e\")", "getUser(\"f\")", "runAs(\"g\")", "assignee = \"h.i\"",
    "Unirest.put(\"https://a.example.com/$id\")", "Unirest.delete(\"https://b.example.com\")", "HttpRequest.newBuilder().uri(URI.create(\"https://c.example.com\"))", "new URL(\"https://d.example.com\")", "httpGet(\"https://e.example.com\")", "httpPost(\"https://f.example.com\")",
    "get(\"/rest/api/3/search?jql\")", "get(\"/rest/agile/1.0/board\")", "get(\"/rest/servicedeskapi/request\")|get(\"/rest/api/3/user/picker\")",
    "class A extends AbstractWorkflowCondition {{|passesCondition", "class L extends AbstractIssueEventListener {{|IssueEvent e|event.getIssue()", "class J extends AbstractJqlFunction {{|getFunctionName()", "log.info(x)|println x|console", "ScheduledService s|cron|JobDetail d",
    "@GET|@POST|CORSRequestBuilder b", "WebPanel p|VelocityParamFactory f|#set ($x)", "WebResourceManager w|requireResource", "ActionDescriptor a|StepDescriptor b|JiraWorkflow c", "<atlassian-plugin>|<rest>|connectDescriptor", "inline my script",
    "getFieldValue(\"a\")|setFieldValue(\"b\")|FieldFunction f", "// Scripted Field|// Calculated Field|return x;// field value|/* scripted field */", "// Mail Handler|getEmailSubject()|getEmailBody()", "RESTEndpoint|getRestParam()|getRequestBody()", "JQLAlias|registerJQL()", "BehavioursService b|// Behaviour",
    "WebItemModuleDescriptor d|FragmentCondition f", "EscalationService e|searchService.searchOverrideSecurity|// Escalation", "onIssueCreated|issue.comment|addLabel", "onIssueUpdated|issue.priority", "workflowAction|addWatcher", "onCommentAdded|sendEmail",
    "onSprintStarted|assignIssue", "onClick userTriggered|createSubtask", "onIssueCreated|PluginAccessor p|addComment", "onIssueCreated", "getCustomFieldValue(cf)", "updateValue(x)", "in JQL", "Files.write(a)|EntityCondition b|onIssueUpdated|x.setValue(1)",
    "WorkflowManager a|ProjectManager b|onIssueUpdated", "IssueManager a|UserManager b|GroupManager c|CustomFieldManager d|WorkflowManager e|ProjectManager f|x.getUsername()", "include \"lib/util.sil\"", "require(\"script_4.groovy\")", "EscalationService e|escalationService f|get(\"/rest/api/3/search\")",
    "LONG", "JqlQueryBuilder q|onIssueUpdated", "transitionIssue(i)", "Unirest.get(\"https://g.example.com\")", "issue.setField(a)",
]
#: Lines that make the script of LONG longer than what counts as long.
LONG = "repeat(concat('x = x + 1', chr(10)), 160)"


def _snippets() -> str:
    told = [LONG if t == "LONG" else "'" + t.replace("|", "' || chr(10) || '") + "'" for t in SNIPPETS]
    return "CASE CAST(floor(o_orderkey / 4.0) AS BIGINT) % " + str(len(told)) + " " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(told)) + " END"


SCRIPTS = """
SELECT o_orderkey AS script_id,
  concat('script_', CAST(o_orderkey AS {S}),
    CASE o_orderkey % 4 WHEN 0 THEN '.groovy' WHEN 1 THEN '.java' WHEN 2 THEN '.sil' ELSE '.txt' END) AS filename,
  concat_ws(chr(10),
   CASE WHEN o_orderkey % 4 = 0 THEN 'import com.atlassian.jira.component.ComponentAccessor' END,
   CASE WHEN o_orderkey % 4 = 1 THEN 'public class Export extends AbstractJiraFunctionProvider {{' END,
   CASE WHEN o_orderkey % 4 = 2 THEN '// SIL Validator' END,
   concat('def cf = cfm.getCustomFieldObject("customfield_', CAST(10000 + o_custkey % 900 AS {S}), '")'),
   CASE WHEN o_orderkey % 3 = 0 THEN concat('issue.setCustomFieldValue("customfield_', CAST(10000 + o_custkey % 700 AS {S}), '", v)') END,
   CASE WHEN o_orderkey % 5 = 0 THEN concat('def u = userManager.getUserByName("user', CAST(o_custkey % 50 AS {S}), '")') END,
   CASE WHEN o_orderkey % 7 = 0 THEN concat('def g = groupManager.getGroup("grp-', CAST(o_custkey % 20 AS {S}), '")') END,
   CASE WHEN o_orderkey % 11 = 0 THEN 'def f = new File("/opt/x.csv")' END,
   CASE WHEN o_orderkey % 13 = 0 THEN concat('Unirest.get("/rest/api/2/issue/P-', CAST(o_orderkey % 100 AS {S}), '")') END,
   CASE WHEN o_orderkey % 17 = 0 THEN 'Unirest.post("https://hooks.example.com/x")' END,
   CASE WHEN o_orderkey % 19 = 0 THEN concat('require("lib/helper', CAST(o_custkey % 30 AS {S}), '.groovy")') END,
   CASE WHEN o_orderkey % 23 = 0 THEN 'Foo.metaClass.bar = 1' END,
   """ + _snippets() + """,
   CASE WHEN o_orderkey % 4 = 2 THEN 'return false;' WHEN o_orderkey % 5 <> 1 THEN 'issue.store()' END) AS content
FROM orders"""
UPLOADS = """
SELECT script_id,
  CASE WHEN script_id % 97 = 3 THEN concat(filename, '.bin') ELSE filename END AS filename,
  CASE WHEN script_id % 97 = 1 THEN '  ' WHEN script_id % 97 = 2 THEN repeat(content, 400) ELSE content END AS content
FROM ({scripts}) s"""
GENERATED_FILES = """
SELECT o_orderkey AS job_id, 'src/index.ts' AS filename, concat_ws(chr(10),
 concat('const f = ATLAS_FIELD_ID("customfield_', CAST(10000 + o_custkey % 900 AS {S}), '");'),
 CASE WHEN o_orderkey % 2 = 0 THEN concat('const u = ATLAS_ACCOUNT_ID("user', CAST(o_custkey % 50 AS {S}), '");') END,
 CASE WHEN o_orderkey % 3 = 0 THEN 'const n = user.getUsername();' END,
 CASE WHEN o_orderkey % 5 = 0 THEN 'await requestJira("/rest/api/2/issue/X");' END,
 CASE WHEN o_orderkey % 7 = 0 THEN 'while (true) {{ step(); }}' END,
 CASE o_orderkey % 23 WHEN 1 THEN 'ComponentAccessor' WHEN 2 THEN 'IssueManager' WHEN 3 THEN 'UserManager' WHEN 4 THEN 'GroupManager' WHEN 5 THEN 'new File("x")' WHEN 6 THEN 'ofBizDelegator'
  WHEN 7 THEN 'getUserByName("a")' WHEN 8 THEN 'userKey = "b"' WHEN 9 THEN 'fetch("https://x.example.com")' WHEN 10 THEN 'maxResults = 5000' WHEN 11 THEN 'const r = "customfield_10077";' END) AS content
FROM orders
UNION ALL
SELECT o_orderkey, 'manifest.yml', concat_ws(chr(10), 'app:', CASE WHEN o_orderkey % 4 <> 0 THEN 'permissions:' END, 'modules:')
FROM orders WHERE o_orderkey % 10 <> 0"""
WORKFLOW_ROWS = """
SELECT o_custkey AS workflow_id, o_orderkey AS action_id, concat('T', CAST(o_orderkey % 5 AS {S})) AS action_name, o_orderstatus AS to_status,
 concat('com.onresolve.jira.groovy.', CASE WHEN o_orderkey % 9 = 0 THEN 'GroovyUnknown' WHEN o_orderkey % 2 = 0 THEN 'GroovyValidator' ELSE 'GroovyFunctionPlugin' END) AS type,
 concat('def cf = "customfield_', CAST(10000 + o_custkey % 900 AS {S}), '"') AS script
FROM orders"""
WORKFLOW_EXPORTS = """
SELECT workflow_id, concat('<workflow name="WF ', CAST(workflow_id AS {S}), '"><actions>', {AGG}, '</actions></workflow>') AS xml
FROM (SELECT workflow_id, action_id, concat('<action id="', CAST(action_id AS {S}), '" name="', action_name,
 '"><results><unconditional-result old-status="Open" status="', to_status, '"><post-functions><function type="', type,
 '"><arg name="script"><![CDATA[', script, ']]></arg></function></post-functions></unconditional-result></results></action>') AS a
 FROM ({workflow_rows}) r) t GROUP BY workflow_id
UNION ALL SELECT -1 - c_custkey, concat('<workflow name="Odd ', CAST(c_custkey AS {S}), '">', CASE c_custkey % 3 WHEN 0 THEN ''
 WHEN 1 THEN '<action id="1" name="T"><function type="com.onresolve.jira.groovy.GroovyFunctionPlugin"><arg name="FIELD_FUNCTION_ID">77</arg></function></action>'
 ELSE '<action id="1" name="T"><function type="com.other.Plain"></function></action>' END, '</workflow>') FROM customer WHERE c_custkey % 10 = 0"""
MAPPING_EVENTS = """
SELECT event_id AS seq, ts, concat('job-', CAST(user_id AS {S})) AS session_id,
 CASE event_id % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'group' ELSE 'user' END AS kind,
 concat('id-', CAST(event_id % 40 AS {S})) AS server_id,
 CASE WHEN event_type = 'error' THEN 'skip' ELSE 'map' END AS op,
 CASE WHEN event_type <> 'error' THEN concat('cloud-', CAST(event_id % 97 AS {S})) END AS cloud_id,
 CASE WHEN event_id % 4 = 0 THEN props END AS notes
FROM events"""
CATALOGUE = """
SELECT concat('cloud-', CAST(k AS {S})) AS cloud_id, name FROM
 (SELECT c_custkey % 80 AS k, min(c_name) AS name FROM customer GROUP BY c_custkey % 80) c"""
JOB_EVENTS = """
SELECT event_id AS seq, ts, user_id AS job_id,
 CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'classifying' WHEN 'signup' THEN 'generating' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'validating' END AS stage,
 value AS ms
FROM events"""
SNAPSHOT_1 = """
SELECT page_id, url, html, 200 AS status, TIMESTAMP '2024-01-01 02:00:00' AS crawled_at FROM pages"""
SNAPSHOT_2 = """
SELECT page_id, url, CASE WHEN page_id % 6 = 0 THEN substr(html, 1, 300) WHEN page_id % 2 = 1 THEN concat(html, '<p>One sentence more.</p>') ELSE html END AS html,
 CASE WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS status, TIMESTAMP '2024-01-08 02:00:00' AS crawled_at
FROM pages WHERE page_id % 11 <> 0"""
#: The estate a week later: every hundredth script has grown by a line, others are gone, some have a copy.
SCRIPTS_2 = """
SELECT script_id, filename, CASE WHEN script_id % 100 = 0 THEN concat(content, chr(10), 'UserManager um') ELSE content END AS content FROM ({scripts}) s WHERE script_id % 100 <> 7
UNION ALL SELECT script_id + 1000000000000, filename, content FROM ({scripts}) s WHERE script_id % 100 = 3"""
CRAWL_TARGETS = """
SELECT CASE WHEN page_id % 40 = 1 THEN replace(url, 'https:', 'ftp:') WHEN page_id % 50 = 2 THEN 'https://docs.example.com/start' ELSE replace(url, 'http:', 'https:') END AS url,
 CASE page_id % 9 WHEN 0 THEN 'forge-api' WHEN 1 THEN 'rest-api-v3' WHEN 2 THEN 'scriptrunner-cloud' WHEN 3 THEN 'connect-api' WHEN 4 THEN 'forge-manifest' WHEN 5 THEN 'oauth-scopes' WHEN 6 THEN 'migration-guide' WHEN 7 THEN 'forge-api' ELSE CASE WHEN page_id % 5 = 0 THEN 'blog' ELSE 'rest-api-v3' END END AS category,
 CASE page_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN CASE WHEN page_id % 11 = 0 THEN 'urgent' ELSE 'low' END ELSE 'low' END AS priority, CASE page_id % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'rarely' ELSE CASE WHEN page_id % 13 <> 0 THEN 'weekly' END END AS frequency
FROM pages"""
TEXTS = {
    "scripts": SCRIPTS, "scripts_2": SCRIPTS_2, "uploads": UPLOADS, "generated_files": GENERATED_FILES, "workflow_rows": WORKFLOW_ROWS,
    "workflow_exports": WORKFLOW_EXPORTS, "mapping_events": MAPPING_EVENTS, "catalogue": CATALOGUE, "job_events": JOB_EVENTS,
    "snapshot_1": SNAPSHOT_1, "snapshot_2": SNAPSHOT_2, "crawl_targets": CRAWL_TARGETS,
}


def text(name: str, dialect: str) -> str:
    joined = "string_agg(a, '' ORDER BY action_id)" if dialect == "duckdb" else "listagg(a, '') WITHIN GROUP (ORDER BY action_id)"
    kind = "VARCHAR" if dialect == "duckdb" else "STRING"
    inner = {k: TEXTS[k].format(S=kind, AGG=joined) for k in ("scripts", "workflow_rows")}
    return TEXTS[name].format(S=kind, AGG=joined, **inner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from it."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = text(name, "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES if f"FROM {t}" in sql}
    if "orders" in used:  # a few numbers become a script each, so a split of the file makes far more work than its bytes tell
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        key = "o_orderkey"
        if name == "workflow_exports":  # dealt as they are put together: texts are not shuffled, and a task's share has a bound
            key, tasks = "o_custkey", max(tasks, -(-used["orders"].count() // EXPORT_ROWS))
        used["orders"] = used["orders"].select("o_orderkey", "o_custkey", "o_orderstatus").repartition(tasks, key)
    return spark.sql(_bind(sql, used), **used)


def _bind(sql: str, used: dict[str, DataFrame]) -> str:
    """Literal braces doubled, table names in braces, as parametrised SQL wants them."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql
