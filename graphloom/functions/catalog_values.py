"""Calls that are sinks and sources of tainted data, by language: fixed values.

Patterns are globs with braces over a callee's qualified name, as in
``py:os.system``; the first that fits, in this order, decides.
"""

#: Id, category, severity, pattern, what the arguments must show (a regular expression) or None.
SINKS = (
    ("csharp.command-exec", "command_exec", "high", "cs:{Process.Start,*.Process.Start,ProcessStartInfo,*.ProcessStartInfo}", None),
    ("csharp.sql-command", "sql", "medium", "cs:{SqlCommand,*.SqlCommand,MySqlCommand,NpgsqlCommand,SqliteCommand}", None),
    ("csharp.sql-execute", "sql", "medium", "cs:*.{ExecuteReader,ExecuteNonQuery,ExecuteScalar,ExecuteReaderAsync,ExecuteNonQueryAsync}", None),
    ("csharp.sql-ef-raw", "sql", "medium", "cs:*.{FromSqlRaw,ExecuteSqlRaw,ExecuteSqlRawAsync}", None),
    ("csharp.deserialization", "deserialization", "medium", "cs:{BinaryFormatter,*.BinaryFormatter,SoapFormatter,NetDataContractSerializer,ObjectStateFormatter,LosFormatter}", None),
    ("csharp.deserialization.call", "deserialization", "medium", "cs:*.{Deserialize,ReadObject}", None),
    ("csharp.code-eval", "code_eval", "critical", "cs:{CSharpScript.EvaluateAsync,Assembly.Load,*.Assembly.Load,Activator.CreateInstance,*.Activator.CreateInstance}", None),
    ("csharp.xxe", "xxe", "medium", "cs:{XmlDocument,*.XmlDocument,XmlTextReader}", None),
    ("csharp.xxe.loadxml", "xxe", "medium", "cs:*.LoadXml", None),
    ("csharp.path-traversal", "path_traversal", "medium", "cs:File.{WriteAllText,WriteAllBytes,Delete,Move,ReadAllText,ReadAllBytes}", None),
    ("csharp.ssrf", "ssrf", "medium", "cs:{*.GetAsync,*.PostAsync,*.SendAsync,WebRequest.Create}", None),
    ("csharp.ldap", "ldap", "medium", "cs:{DirectorySearcher,*.DirectorySearcher}", None),
    ("go.command-exec.exec", "command_exec", "high", "go:os/exec.{Command,CommandContext}", None),
    ("go.command-exec.os", "command_exec", "high", "go:os.StartProcess", None),
    ("go.sql-query", "sql", "medium", "go:*.{Query,QueryRow,Exec,QueryContext,ExecContext,QueryRowContext}", r"\+|Sprintf"),
    ("go.file-write", "file_write", "low", "go:os.{OpenFile,WriteFile,Create,Remove,RemoveAll}", None),
    ("go.network-out", "network_out", "low", "go:net/http.{Get,Post,PostForm,Head}", None),
    ("go.path-traversal", "path_traversal", "medium", "go:{os.Open,os.ReadFile,io/ioutil.{ReadFile,WriteFile}}", None),
    ("go.ssrf", "ssrf", "medium", "go:net/http.{NewRequest,NewRequestWithContext}", None),
    ("go.weak-crypto", "weak_crypto", "low", "go:{crypto/md5.{New,Sum},crypto/sha1.{New,Sum},crypto/des.NewCipher,crypto/rc4.NewCipher,math/rand.{Int,Intn,Float64}}", None),
    ("go.template-injection", "template_injection", "medium", "go:text/template.{New,Must}", None),
    ("go.command-exec.syscall", "command_exec", "high", "go:syscall.{Exec,ForkExec,StartProcess}", None),
    ("go.deserialization", "deserialization", "medium", "go:encoding/gob.NewDecoder", None),
    ("go.xxe", "xxe", "medium", "go:encoding/xml.{Unmarshal,NewDecoder}", None),
    ("go.dynamic-load", "dynamic_load", "high", "go:plugin.Open", None),
    ("java.command-exec", "command_exec", "high", "java:{*.exec,Runtime.exec,ProcessBuilder,*.ProcessBuilder}", None),
    ("java.sql-query", "sql", "medium", "java:*.{executeQuery,executeUpdate,executeLargeUpdate,executeBatch}", None),
    ("java.sql-execute", "sql", "medium", "java:*.execute", r"(?i)\b(select|insert|update|delete|from|where|drop|truncate|alter|union|sql)\b|\+"),
    ("java.deserialization", "deserialization", "high", "java:*.readObject", None),
    ("java.code-eval", "code_eval", "critical", "java:*.eval", None),
    ("java.ssrf", "ssrf", "medium", "java:*.{openConnection,openStream}", None),
    ("java.xxe", "xxe", "medium", "java:*.{newDocumentBuilder,newSAXParser,newXMLReader,createXMLStreamReader}", None),
    ("java.deserialization.extra", "deserialization", "high", "java:{XMLDecoder,*.XMLDecoder,*.readUnshared,*.enableDefaultTyping}", None),
    ("java.jndi", "jndi", "medium", "java:*.lookup", r"[^()\s]"),
    ("java.expression-injection", "template_injection", "high", "java:*.{parseExpression,createTemplate}", None),
    ("java.expression-injection.evaluate", "template_injection", "high", "java:*.evaluate", r"[^()\s]"),
    ("java.path-traversal", "path_traversal", "medium", "java:{FileInputStream,*.FileInputStream,FileReader,*.FileReader,Files.readAllBytes,*.Files.readAllBytes,Paths.get}", None),
    ("js.command-exec.child_process", "command_exec", "high", "js:child_process.{exec,execSync,spawn,spawnSync,execFile,execFileSync}", None),
    ("js.command-exec.member", "command_exec", "high", "js:*.{execSync,spawn,spawnSync}", None),
    ("js.code-eval", "code_eval", "critical", "js:{eval,Function}", None),
    ("js.sql-query", "sql", "medium", "js:*.{query,execute,raw}", r"\+|\$\{|`"),
    ("js.file-write", "file_write", "low", "js:{fs.writeFile,fs.writeFileSync,fs.appendFile,fs.rm,fs.rmSync,fs.unlink}", None),
    ("js.network-out", "network_out", "low", "js:{fetch,axios.get,axios.post,http.get,https.get}", None),
    ("js.ssrf", "ssrf", "medium", "js:{axios.{request,put,delete,patch},got,http.request,https.request,undici.{request,fetch}}", r"\+|\$\{|`"),
    ("js.path-traversal", "path_traversal", "medium", "js:fs.{readFile,readFileSync,createReadStream,open,openSync}", r"\+|\$\{|`"),
    ("js.template-injection", "template_injection", "high", "js:{ejs.render,handlebars.compile,pug.render,nunjucks.renderString,lodash.template}", None),
    ("js.code-eval.vm", "code_eval", "critical", "js:vm.{runInNewContext,runInThisContext,runInContext}", None),
    ("js.weak-crypto", "weak_crypto", "low", "js:crypto.createHash", "md5|sha1"),
    ("lib.js.knex.raw", "sql", "medium", "js:{knex.raw,*.knex.raw}", r"\+|\$\{|`"),
    ("lib.js.sequelize.query", "sql", "medium", "js:{sequelize.query,*.sequelize.query}", None),
    ("lib.js.shelljs.exec", "command_exec", "high", "js:{shelljs.exec,shell.exec,*.shelljs.exec}", None),
    ("lib.js.execa", "command_exec", "high", "js:{execa,execa.command,execa.sync,execa.commandSync}", None),
    ("lib.py.fabric.run", "command_exec", "high", "py:{fabric.api.run,fabric.api.sudo,fabric.api.local,fabric.operations.run,fabric.operations.sudo,*.Connection.run,*.Connection.sudo}", None),
    ("lib.py.paramiko.exec", "command_exec", "high", "py:*.exec_command", None),
    ("lib.py.sh", "command_exec", "high", "py:{sh.Command,sh.bash,sh.sh}", None),
    ("lib.py.invoke.run", "command_exec", "high", "py:{invoke.run,invoke.sudo,*.Context.run,*.Context.sudo}", None),
    ("php.command-exec", "command_exec", "high", "php:{exec,system,shell_exec,passthru,popen,proc_open,pcntl_exec}", None),
    ("php.code-eval", "code_eval", "critical", "php:{eval,assert,create_function}", None),
    ("php.code-eval.callback", "code_eval", "critical", "php:{call_user_func,call_user_func_array}", r"\$"),
    ("php.code-inclusion", "code_inclusion", "critical", "php:{include,include_once,require,require_once}", r"\$"),
    ("php.deserialization", "deserialization", "high", "php:unserialize", None),
    ("php.sql", "sql", "high", "php:{mysqli_query,mysqli_multi_query,pg_query,sqlite_query}", None),
    ("php.sql.pdo-query", "sql", "high", "php:*.{query,exec}", r"\$"),
    ("php.sql.pdo-prepare", "sql", "low", "php:*.prepare", r"\$"),
    ("php.path-traversal", "path_traversal", "medium", "php:{file_get_contents,file_put_contents,fopen,readfile,unlink}", r"\$"),
    ("php.ssrf", "ssrf", "medium", "php:{curl_exec,curl_init,fsockopen}", None),
    ("php.template-injection", "template_injection", "high", "php:*.render", r"\$"),
    ("php.ldap", "ldap", "medium", "php:{ldap_search,ldap_bind}", None),
    ("php.xxe", "xxe", "medium", "php:{simplexml_load_string,simplexml_load_file}", None),
    ("php.weak-crypto", "weak_crypto", "low", "php:{md5,sha1,mt_rand,rand}", None),
    ("py.command-exec.subprocess", "command_exec", "high", "py:subprocess.{run,call,check_call,check_output,Popen,getoutput,getstatusoutput}", None),
    ("py.command-exec.os", "command_exec", "high", "py:os.{system,popen,execv,execve,execvp,execl,execlp,spawnv,spawnl,startfile}", None),
    ("py.code-eval", "code_eval", "critical", "py:{eval,exec,compile,builtins.eval,builtins.exec}", None),
    ("py.sql-execute", "sql", "medium", "py:*.{execute,executemany,executescript}", None),
    ("py.deserialization.pickle", "deserialization", "high", "py:{pickle,cPickle,marshal,shelve}.{load,loads,open}", None),
    ("py.deserialization.yaml", "deserialization", "high", "py:yaml.{load,unsafe_load,full_load}", None),
    ("py.template-injection.flask", "template_injection", "high", "py:{flask.render_template_string,*.render_template_string}", None),
    ("py.file-write", "file_write", "low", "py:{shutil.rmtree,shutil.move,os.remove,os.unlink,os.rmdir,*.write_text,*.write_bytes}", None),
    ("py.network-out", "network_out", "low", "py:{requests.{get,post,put,delete,patch,request},urllib.request.urlopen,httpx.{get,post,request}}", None),
    ("py.ssrf", "ssrf", "medium", "py:{requests.{get,post,put,delete,patch,request},urllib.request.{urlopen,Request},httpx.{get,post,request,stream}}", '\\+|%|format|f[\'"]'),
    ("py.path-traversal", "path_traversal", "medium", "py:{open,io.open}", '\\+|%|format\\(|f[\'"]'),
    ("py.xxe", "xxe", "medium", "py:{xml.etree.ElementTree.{parse,fromstring},lxml.etree.{parse,fromstring,XML},xml.dom.minidom.{parse,parseString},xml.sax.{parse,parseString}}", None),
    ("py.weak-crypto", "weak_crypto", "low", "py:hashlib.{md5,sha1}", None),
    ("py.deserialization.extra", "deserialization", "high", "py:{dill,cloudpickle,joblib}.{load,loads}", None),
    ("py.template-injection.libs", "template_injection", "high", "py:{jinja2.Template,mako.template.Template,django.template.Template}", None),
    ("py.dynamic-import", "code_eval", "medium", "py:{importlib.import_module,__import__}", None),
    ("rb.command-exec.kernel", "command_exec", "high", "rb:{system,exec,spawn}", r"\#\{|(?:^|[(,])\s*[\[*&]?\s*[a-zA-Z_@$]"),
    ("rb.command-exec.process", "command_exec", "high", "rb:{fork,syscall}", None),
    ("rb.command-exec.attr", "command_exec", "high", "rb:*.{system,exec,spawn}", r"\#\{|(?:^|[(,])\s*[\[*&]?\s*[a-zA-Z_@$]"),
    ("rb.code-eval", "code_eval", "critical", "rb:{eval,instance_eval,class_eval,module_eval,define_method}", None),
    ("rb.code-eval.attr", "code_eval", "critical", "rb:*.{eval,instance_eval,class_eval,module_eval}", None),
    ("rb.sql-query", "sql", "medium", "rb:*.{find_by_sql,exec_query,exec_update,exec_delete,select_all,select_one,select_value,select_rows}", None),
    ("rb.sql-execute", "sql", "medium", "rb:*.execute", r"(?i)\b(select|insert|update|delete|from|where|drop|truncate|alter|union|sanitize_sql|arel)\b|\#\{"),
    ("rb.command-exec.open3", "command_exec", "high", "rb:*.{capture2,capture2e,capture3,popen2,popen3,popen2e}", r"\#\{|(?:^|[(,])\s*[\[*&]?\s*[a-zA-Z_@$]"),
    ("rb.deserialization", "deserialization", "high", "rb:*.{load,restore,unsafe_load,object_load}", r"params|\#\{|@|\("),
    ("rb.code-eval.send", "code_eval", "high", "rb:*.{send,public_send,constantize,const_get}", r"params|\#\{|@"),
    ("rb.path-traversal", "path_traversal", "medium", "rb:*.{read,open,write,binread}", r"params|\#\{|\+"),
    ("rb.ssrf", "ssrf", "medium", "rb:*.{get_response,post_form}", None),
    ("rb.template-injection", "template_injection", "high", "rb:*.{new,result}", r"\#\{"),
    ("rust.command-exec", "command_exec", "high", "rs:{std.process.Command.new,Command.new,*.Command.new}", None),
    ("rust.sql-query", "sql", "medium", "rs:{sqlx.query,sqlx.query_as,sqlx.query_scalar,sqlx.raw_sql,diesel.sql_query,*.sql_query}", None),
    ("rust.path-traversal", "path_traversal", "medium", "rs:std.fs.{write,read,read_to_string,remove_file,remove_dir_all,copy,rename}", None),
    ("rust.file-alias", "path_traversal", "medium", "rs:fs.{write,read,read_to_string,remove_file}", None),
    ("rust.ssrf", "ssrf", "low", "rs:{reqwest.get,reqwest.blocking.get}", None),
    ("rust.dynamic-load", "dynamic_load", "medium", "rs:{libloading.Library.new,*.Library.new}", None),
    ("rust.deserialization", "deserialization", "medium", "rs:{bincode.deserialize,serde_yaml.from_str}", None),
    ("rust.path-traversal.tokio", "path_traversal", "medium", "rs:tokio.fs.{read,read_to_string,write,remove_file,remove_dir_all,copy,rename}", None),
    ("rust.file-write", "file_write", "low", "rs:{std.fs.{File.create,OpenOptions.new,create_dir,create_dir_all},fs.{File.create,OpenOptions.new,create_dir,create_dir_all},File.create,OpenOptions.new}", None),
    ("rust.network-out", "network_out", "low", "rs:{reqwest.Client.{get,post,put,patch,delete,request},reqwest.blocking.Client.{get,post,request},ureq.{get,post,put,delete,request}}", None),
    ("rust.sql-raw", "sql", "medium", "rs:*.{execute,execute_batch,batch_execute,query,query_one,query_opt,query_raw}", r"format!|\+|push_str"),
    ("rust.deserialization.msgpack", "deserialization", "medium", "rs:{rmp_serde.{from_slice,from_read},serde_cbor.{from_slice,from_reader},serde_pickle.from_slice}", None),
)

#: Id, category, pattern, channel or None.
SOURCES = (
    ("csharp.http.body", "http_input", "cs:*.{ReadFromJsonAsync,ReadAsStringAsync}", "body"),
    ("csharp.stdin", "stdin_input", "cs:*.ReadLine", None),
    ("csharp.env", "env_input", "cs:Environment.GetEnvironmentVariable", None),
    ("go.http.form", "http_input", "go:*.{FormValue,PostFormValue}", "form"),
    ("go.http.query", "http_input", "go:*.Query", "query"),
    ("go.gin.path", "http_input", "go:*.Param", "path"),
    ("go.gin.header", "http_input", "go:*.GetHeader", "header"),
    ("go.gin.body", "http_input", "go:*.{Bind,BindJSON,ShouldBind,ShouldBindJSON}", "body"),
    ("go.cli-flags", "cli_arg", "go:*.{GetString,GetStringSlice,GetStringArray,GetInt,GetInt64,GetBool,GetFloat64,GetDuration}", None),
    ("go.env", "env_input", "go:os.Getenv", None),
    ("java.servlet.query", "http_input", "java:*.{getParameter,getParameterValues,getQueryString}", "query"),
    ("java.servlet.header", "http_input", "java:*.{getHeader,getHeaders}", "header"),
    ("java.servlet.cookie", "http_input", "java:*.getCookies", "cookie"),
    ("java.servlet.body", "http_input", "java:*.{getInputStream,getReader}", "body"),
    ("java.env", "env_input", "java:System.getenv", None),
    ("js.cli-args", "cli_arg", "js:*.{opts,parseSync}", None),
    ("js.express.body", "http_input", "js:*.body", "body"),
    ("js.express.query", "http_input", "js:*.query", "query"),
    ("js.express.params", "http_input", "js:*.params", "path"),
    ("js.express.header", "http_input", "js:*.headers", "header"),
    ("js.express.cookie", "http_input", "js:*.cookies", "cookie"),
    ("php.superglobal.get", "http_input", "php:$_GET", "query"),
    ("php.superglobal.post", "http_input", "php:$_POST", "form"),
    ("php.superglobal.request", "http_input", "php:$_REQUEST", "body"),
    ("php.superglobal.cookie", "http_input", "php:$_COOKIE", "cookie"),
    ("php.console.input", "cli_arg", "php:*.{getArgument,getOption}", None),
    ("php.filter-input", "http_input", "php:{filter_input,filter_input_array}", None),
    ("php.request.body", "http_input", "php:*.input", "body"),
    ("php.request.query", "http_input", "php:*.query", "query"),
    ("php.request.form", "http_input", "php:*.post", "form"),
    ("php.request.cookie", "http_input", "php:*.cookie", "cookie"),
    ("php.request.header", "http_input", "php:*.header", "header"),
    ("py.flask.query", "http_input", "py:flask.request.args*", "query"),
    ("py.flask.form", "http_input", "py:flask.request.form*", "form"),
    ("py.flask.header", "http_input", "py:flask.request.headers*", "header"),
    ("py.flask.cookie", "http_input", "py:flask.request.cookies*", "cookie"),
    ("py.flask.body", "http_input", "py:flask.request.{json,get_json,data,get_data,stream,files}*", "body"),
    ("py.flask.request", "http_input", "py:flask.request*", None),
    ("py.fastapi.query", "http_input", "py:{fastapi,starlette.*}.Query", "query"),
    ("py.fastapi.path", "http_input", "py:{fastapi,starlette.*}.Path", "path"),
    ("py.fastapi.header", "http_input", "py:{fastapi,starlette.*}.Header", "header"),
    ("py.fastapi.cookie", "http_input", "py:{fastapi,starlette.*}.Cookie", "cookie"),
    ("py.fastapi.form", "http_input", "py:{fastapi,starlette.*}.Form", "form"),
    ("py.fastapi.body", "http_input", "py:{fastapi,starlette.*}.{Body,File,UploadFile}", "body"),
    ("py.stdin", "user_input", "py:{input,sys.stdin.*}", None),
    ("py.cli-args", "cli_arg", "py:*.{parse_args,parse_known_args}", None),
    ("py.env", "env_input", "py:{os.getenv,os.environ.get}", None),
    ("rb.sinatra.params", "http_input", "rb:{params*,*.params*}", None),
    ("rb.env", "env_input", "rb:*.{fetch}", None),
    ("rust.env", "env_input", "rs:{std.env.var,env.var}", None),
    ("rust.cli-args", "cli_arg", "rs:{std.env.args,env.args,std.env.args_os,env.args_os}", None),
    ("rust.clap.matches", "cli_arg", "rs:*.{value_of,values_of,get_one,get_many}", None),
    ("rust.stdin", "stdin_input", "rs:{std.io.stdin,io.stdin}", None),
)
